"""SQL text for the oracles, generated from the same rule tables as the Columns."""

from __future__ import annotations

from ..functions import rules as R


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def value(x: object) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(value, x)) + "]"
    return quoted(x) if isinstance(x, str) else f"{x!r}::double" if isinstance(x, float) else str(x)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A CTE with literal rows."""
    return f"{name}({columns}) as (values {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)})"


def listed(words: tuple | list) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"regexp_replace({x}, '\\s+', ' ', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def first(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, {quoted(pattern)}, {group}), '')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {quoted(R.TOKEN)})"


def surface(x: str) -> str:
    """Tokens and the parts of compounds, as a list."""
    split = f"list_concat([t], list_filter(string_split_regex(t, '{R.COMPOUND}'), lambda p: length(p) > 1))"
    return f"flatten(list_transform({tokens(x)}, lambda t: case when regexp_matches(t, '{R.COMPOUND}') then {split} else [t] end))"


def _fits(col: str, suffix: str) -> str:
    guard = f" and not ends_with({col}, 'ss')" if suffix in ("s", "es") else ""
    return f"ends_with({col}, '{suffix}') and length({col}) >= {len(suffix) + R.MIN_STEM}{guard}"


def _pass(col: str) -> str:
    return "case " + " ".join(f"when {_fits(col, s)} then left({col}, length({col}) - {len(s)}) || '{new}'" for s, new in R.SUFFIXES) + f" else {col} end"


def _plural(col: str) -> str:
    return "case " + " ".join(f"when {_fits(col, s)} then {str(s in R.PLURALS).lower()}" for s, _ in R.SUFFIXES) + " else false end"


def stem_ctes(name: str, source: str) -> str:
    """CTEs that add ``term``, the stem of ``token``, to the rows of table ``source``; the last is ``name``."""
    return f"""{name}_1 as (select *, {_pass('token')} as s1, {_plural('token')} as p1 from {source}),
{name}_2 as (select *, case when p1 then {_pass('s1')} else s1 end as s2 from {name}_1),
{name} as (select * exclude (s1, p1, s2), case when length(token) <= {R.MIN_STEM} or regexp_matches(token, '[0-9]') then token
  when length(s2) > {R.MIN_STEM} and ends_with(s2, 'e') then left(s2, length(s2) - 1) else s2 end as term from {name}_2)"""


def term_ctes(name: str, source: str, key: str, text: str) -> str:
    """CTE ``name`` (key, token, term), a row for each index term of ``source``."""
    return f"{name}_0 as (select {key} as key, unnest({surface(text)}) as token from {source}),\n{stem_ctes(name, f'{name}_0')}"


def bm25_ctes(questions: str = "select item_id as query_id, text from benchmark", corpus: str = "select doc_id as chunk_id, text from documents", allowed: str = "true", key: str = "chunk_id") -> str:
    """CTEs up to ``bm25`` (query_id, chunk_id, score); statistics of the whole corpus, scores of the allowed."""
    return f"""corpus as ({corpus}), asked as ({questions}),
{term_ctes('ct', 'corpus', key, 'text')},
{term_ctes('qt', 'asked', 'query_id', 'text')},
post as (select key, term, count(*) as tf from ct group by all),
len as (select c.{key} as key, coalesce(sum(tf), 0) as length from corpus c left join post p on p.key = c.{key} group by 1),
st as (select count(*) as n, avg(length::double) as av from len),
dfs as (select term, count(*) as df from post group by term),
qw as (select key as query_id, term, count(*) as times from qt group by all),
bm25 as (
  select q.query_id, p.key as chunk_id,
    sum(q.times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {R.BM25_K1 + 1} / (tf + {R.BM25_K1} * (1 - {R.BM25_B} + {R.BM25_B} * length / case when av > 0 then av else 1 end))) as score
  from qw q join post p using (term) join dfs using (term) join len l on l.key = p.key cross join st
  where p.key in (select {key} from corpus where {allowed}) group by all having score > 0
)"""
