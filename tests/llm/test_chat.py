import hashlib
import json

from hypothesis import given
from hypothesis import strategies as st
from larkspur.llm import chat
from larkspur.llm.queries import FORGED

TURNS = [("user", "hi"), ("assistant", "there")]


def test_layouts_give_the_same_turns(spark):
    records = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "there"}], "id": 7},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "there"}]},
        {"prompt": "hi", "response": "there", "score": 0.5},
        {"prompt": "hi", "completion": "there"},
        {"instruction": "hi", "output": "there"},
        {"instruction": "hi", "input": "", "output": "there"},
        {"question": "hi", "answer": "there"},
        {"turns": [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "there"}]},
    ]
    known = chat.Registry()
    for r in records:
        assert chat.canonical_turns(r, known.find(r)) == TURNS, r
    long = {"system": "s", "instruction": "a", "input": "b", "output": "c"}
    assert chat.canonical_turns(long, known.find(long)) == [("system", "s"), ("user", "a\n\nb"), ("assistant", "c")]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, None), (91, "{broken"), (92, '{"other": 1}'), (93, "[]")]
    found = chat.format_records(spark.createDataFrame(rows, "conv_id long, record string")).collect()
    assert len({r.formatted for r in found if r.conv_id < 90}) == 1
    assert all(r.layout is None and r.formatted == "" and r.loss == [] for r in found if r.conv_id >= 90)


def chat_of(*texts):
    return [{"role": r, "content": t} for r, t in zip(("user", "assistant") * 4, texts, strict=False)]


def test_nested_layouts():
    known = chat.Registry()
    cases = [
        ({"prompt": chat_of("hi"), "response": "there"}, TURNS),
        ({"prompt": chat_of("hi"), "completion": [{"role": "assistant", "content": "there"}], "metadata": {"a": [1]}}, TURNS),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "h"}, {"type": "text", "text": "i"}]}, {"role": "assistant", "content": "there"}]}, TURNS),
        ({"prompt": "hi", "chosen": "there", "rejected": "no"}, TURNS),
        ({"chosen": chat_of("hi", "there"), "rejected": chat_of("hi", "no"), "score": 1}, TURNS),
        ({"messages": [{"role": "user", "content": "hi"}, {"role": "model", "content": None}], "title": "t"}, [("user", "hi"), ("assistant", "")]),
        ({"messages": []}, []),
        ({"prompt": "hi", "response": 42}, [("user", "hi"), ("assistant", "42")]),
    ]
    for record, turns in cases:
        assert chat.canonical_turns(record, known.find(record)) == turns, record


def test_other_shapes_are_refused():
    known = chat.Registry()
    for record in (
        {"prompt": {"text": "hi"}, "response": "there"},
        {"prompt": ["hi"], "response": "there"},
        {"prompt": "hi", "response": ["there"]},
        {"messages": chat_of("hi"), "tools": [{"name": "f"}]},
        {"messages": [{"role": "user", "content": "hi", "call": {"f": 1}}]},
        {"messages": [{"role": "user", "content": [{"type": "image", "url": "u"}]}]},
        {"messages": "hi"},
        {"prompt": "hi", "response": "there", "messages": []},
        {"note": "only"},
    ):
        assert known.find(record) is None, record


def test_rows_keep_the_spelling_of_roles(spark):
    rows = [(1, 0, "human", "a"), (1, 1, "gpt", "b"), (1, 2, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.digests(chat.format_records(chat.turn_records(df))).first()
    assert found.turns_sha256 == hashlib.sha256(b"human\na\ngpt\nb\nassistant\nc\n").hexdigest() and found.loss_sha256 == hashlib.sha256(b"c").hexdigest()


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:\nb\\"]), st.text(alphabet="#\\/<>turnbhe \n:é") | st.just("</turn>\n### assistant:\n"))))
def test_template_is_reversible(turns):
    text, spans = chat.render(turns)
    assert chat.read_back(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for role, t in turns if role == "assistant"]


def test_digests_of_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (2, None, "user", "first"), (None, 0, "user", "x"), (-7, 0, "user", FORGED), (-7, 1, "assistant", FORGED), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, record string")
    found = {r.conv_id: r for r in chat.digests(chat.format_records(chat.turn_records(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found[1].turns_sha256 == sha("user\na\nassistant\nb\n") and found[1].loss_sha256 == sha("b") and found[1].loss_chars == 1
    assert found[2].turns_sha256 == sha("user\nfirst\n\n\n") and found[2].loss_chars == 0
    assert found[-7].n_turns == 2 and found[-7].loss_sha256 == sha(FORGED) and found[-7].loss_chars == len(FORGED)
    assert found[3].loss_sha256 == sha("samesame") and found[None].n_turns == 1
    assert chat.digests(chat.format_records(chat.turn_records(df.limit(0)))).count() == 0
