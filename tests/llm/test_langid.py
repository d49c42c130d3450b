import zlib

from larkspur.llm import langid
from larkspur.llm.common import bucket_of, table


def test_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn_profiles(docs, bucket_of("doc_id", 4) != 2)
    found = {r.doc_id: r for r in langid.predict_languages(docs, profiles).collect()}
    held = [r for r in docs.select("doc_id", "lang").collect() if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(found[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())


def brute(text, profiles, places):
    """Out-of-place distances by the book."""
    counts = {}
    for g in langid.ngrams(text):
        counts[g] = counts.get(g, 0) + 1
    if not counts:
        return "und", 0.0
    ranked = sorted(counts, key=lambda g: (-counts[g], len(g), g.replace(" ", "\1")))[:places]
    away = []
    for grams in profiles.ranked:
        place = {g: i for i, g in enumerate(grams)}
        away.append(sum(abs(place[g] - i) if g in place else places for i, g in enumerate(ranked)))
    return profiles.languages[away.index(min(away))], 1 - min(away) / (places * len(ranked))


def test_ranker_equals_the_plain_method(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn_profiles(docs, bucket_of("doc_id", 4) != 2, places=60)
    ranker = langid.Ranker(profiles, 60)
    texts = [r.text for r in docs.select("text").limit(60).collect()]
    for text in [*texts, "日本語 の テキスト", "ab", "a", "1", "é", "\U0001d4d0 x", " a\nb  c--d "]:
        lang, score = brute(text, profiles, 60)
        found = ranker.predict(text)
        assert found[0] == lang and abs(found[1] - score) < 1e-12


def test_large_alphabets_need_no_more_memory():
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    profiles = langid.Profiles(("a", "b"), (tuple(letters[:1500]), tuple(letters[1500:])))
    ranker = langid.Ranker(profiles, 300)
    assert ranker.predict(letters[1600] * 3)[0] == "b" and ranker.keys.nbytes + ranker.rank.nbytes < 100_000


def test_odd_texts(spark):
    rows = [(1, "der die das und", "de"), (2, "the of and to", "en"), (3, None, "en"), (4, "123 !? \n", None), (5, "日本", None), (6, "the " * 50000, None), (None, "und der", None), (2, "the of and to", "en")]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, lang string, score double")
    profiles = langid.learn_profiles(docs, docs["doc_id"] < 3)
    assert profiles.languages == ("de", "en")
    found = langid.predict_languages(docs, profiles).collect()
    got = [(r.doc_id, r.lang_pred) for r in found]
    assert len(got) == len(rows) and (3, "und") in got and (4, "und") in got and (6, "en") in got and (None, "de") in got and (5, "de") in got
    none = langid.learn_profiles(docs.limit(0), docs["doc_id"] < 3)
    assert {r.lang_pred for r in langid.predict_languages(docs, none).collect()} == {"und"}
    assert langid.predict_languages(docs.limit(0), profiles).count() == 0
