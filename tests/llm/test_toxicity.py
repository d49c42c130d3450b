import itertools
import random
import zlib

from larkspur.llm import toxicity
from larkspur.llm.common import bucket_of, table


def score(text):
    return sum(toxicity.Reader(toxicity.SEED).clauses(text)[0])


def test_grammar_scores_clauses_not_words():
    assert score("you are an idiot") > score("an idiot") > 0
    assert score("he is not an idiot") < score("he is an idiot")
    assert score("they said he is an idiot") < score("he is an idiot")
    assert score("kill time") == 0 < score("I will kill you")
    assert score("I will not kill you") < score("I will kill you")
    assert score("I kill. You") == 0  # no match across clauses
    assert score("he is an idiot she said") == score("he is an idiot she was")  # what comes before the reporting word stands
    assert score("du bist ein dummkopf") > score("ein dummkopf") > score("nicht ein dummkopf")
    assert score("vous êtes un crétin") > score("jamais crétin") > 0 < score("ich werde dich töten und dich") and score("te mataré a ti") > 0
    assert score("") == 0 == score("a clean text, with nothing.")


def naive(clause):
    """Sum over all readings of a clause, each walked through the single machines."""
    total = 0.0
    choices = [[(s, 1.0), *([(toxicity.THE_INSULT, w)] if s == toxicity.INSULT else [])] for s, w in clause]
    machines = toxicity.clause_machines()
    for reading in itertools.product(*choices):
        paths = [(1.0, [s for s, _ in reading])]
        for _, w in reading:
            paths = [(p * w, out) for p, out in paths]
        for machine in machines:
            paths = [(w * v, written) for w, symbols in paths for v, written in walks(machine, machine.start, symbols)]
        total += sum(w for w, _ in paths)
    return total


def walks(machine, state, symbols):
    if not symbols:
        return [(machine.final[state], [])] if state in machine.final else []
    out = []
    for at, read, write, goal, weight in machine.arcs:
        if at == state and read == symbols[0]:
            out += [(weight * w, [write, *rest]) for w, rest in walks(machine, goal, symbols[1:])]
    return out


def test_composed_machine_equals_naive_path_enumeration():
    r = random.Random(1)
    grammar = toxicity.ClauseGrammar()
    for _ in range(250):
        symbols = [r.choice([*toxicity.UNMARKED, toxicity.OTHER, toxicity.INSULT, toxicity.THREAT]) for _ in range(r.randint(1, 9))]
        clause = [(s, r.choice([1.5, 3.0])) for s in symbols]
        placed = [(i, s, w) for i, (s, w) in enumerate(clause) if s != toxicity.OTHER or i == 0]
        assert abs(grammar.score(placed) - naive(clause)) < 1e-9, clause


def test_long_runs_of_other_words_settle():
    grammar = toxicity.ClauseGrammar()
    for gap in (grammar.SETTLED, 50):
        far = [(0, toxicity.NEGATION, 0.0), (gap + 1, toxicity.INSULT, 2.0), (2 * gap + 2, toxicity.TARGET, 0.0)]
        assert grammar.score(far) == 2.0


def test_balanced_labels_still_teach_words(spark):
    docs = spark.createDataFrame([(i, f"fine words {'zorgu' if i % 2 else 'apple'} here") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    grammar = toxicity.learn_grammar(docs, labels, bucket_of("doc_id", 5) != 0)
    assert "zorgu" in grammar.insults and "apple" not in grammar.insults


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grammar = toxicity.learn_grammar(docs, labels, bucket_of("doc_id", 5) != 0)
    found = {r.doc_id: r.score for r in toxicity.score_documents(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), grammar).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in found]
    toxic, clean = [found[r.doc_id] for r in held if r.toxic], [found[r.doc_id] for r in held if not r.toxic]
    assert sum(s >= 0.5 for s in toxic) >= 0.85 * len(toxic)
    assert sum(s >= 0.5 for s in clean) <= 0.02 * len(clean)


def test_odd_tables(spark):
    rows = [(1, "you idiot", 1), (2, None, 0), (3, "", 0), (4, "idiot " * 50000, 1), (None, "you are scum", 0), (1, "you idiot", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    grammar = toxicity.learn_grammar(docs, empty, bucket_of("doc_id", 5) != 0)
    assert grammar == toxicity.SEED
    scores = toxicity.score_documents(docs, grammar).collect()
    assert len(scores) == len(rows) and all(0 <= r.score <= 1 for r in scores)
    assert sorted((r.doc_id for r in toxicity.keep_civil(docs, grammar).collect()), key=str) == [2, 3]
    assert toxicity.keep_civil(docs, grammar).columns == docs.columns
    assert toxicity.score_documents(docs.limit(0), grammar).count() == 0


def test_labels_of_one_kind_and_null_labels(spark):
    docs = spark.createDataFrame([(i, "you idiot") for i in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 1) for i in range(9)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.learn_grammar(docs, labels, bucket_of("doc_id", 5) != 0) == toxicity.SEED
