import zlib

import numpy as np

from paperloom.llm import langid as L


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs)
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert set(got) == set(lang)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].lang_pred == lang[i] for i in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert sum(r.rejected for r in got.values()) <= 0.01 * len(got)
    # whole texts count: what comes after a long foreign beginning decides
    de, en = (next(r.text for r in docs.collect() if r.lang == x and len(r.text) > 2000) for x in ("de", "en"))
    assert model.predict(de[:300] + " " + en * 5)[0] == "en" and model.predict(en[:300] + " " + de * 5)[0] == "de"


def test_odd_rows(spark):
    train = spark.createDataFrame([(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 3, "en" if i % 2 else "de", 1) for i in range(60)] + [(100, None, "en", 1), (None, "x", None, 1)], "doc_id long, text string, lang string, score int")
    model = L.fit(train, per_language=20)
    df = spark.createDataFrame([(1, None, None), (2, "", None), (3, " 12 !? ", None), (4, "the dog", "xx"), (4, "the dog", "xx"), (None, "die katze", None), (5, "der " * 100_000, None)], "doc_id long, text string, lang string")
    got = L.identify(df, model).collect()
    assert len(got) == 7
    by = {r.doc_id: r for r in got}
    for i in (1, 2, 3):
        assert by[i].lang_pred == "und" and by[i].rejected and by[i].score == 0
    assert by[4].lang_pred == "en" and by[None].lang_pred == "de" and not by[None].held_out and by[5].lang_pred == "de"
    assert L.identify(df.limit(0), model).count() == 0
    kept = L.keep_known(df, model)
    assert kept.columns == df.columns and kept.count() <= 4


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    (r,) = L.identify(df, L.fit(df)).collect()
    assert r.lang_pred == "und"


def test_unlearned_languages_and_gibberish_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs)
    foreign = [
        "Il gatto nero dorme sul tetto della casa vecchia mentre la pioggia cade piano.",
        "De oude man loopt elke ochtend langzaam door het stille park naar de bakker.",
        "Stary człowiek idzie powoli przez cichy park do piekarni każdego ranka.",
        "今天天气很好，我们一起去公园散步吧。",
        "今日はとても天気がいいので、公園を散歩しましょう。",
        "Старый человек медленно идёт через тихий парк каждое утро.",
        "xqzv kjwq pfgh zzxv wqkj bvnm qqtr plkj hgfd xcvb",
    ]
    for text in foreign:
        assert model.predict(text)[2] and model.predict(f"{text} " * 20)[2], text
    rows = docs.collect()
    right = [r for r in rows if model.predict(r.text)[0] == r.lang]
    assert sum(model.predict(r.text)[2] for r in right) <= 0.005 * len(right)


def test_temperature_is_no_edge():
    z = np.array([[0.02, 0.0], [0.0, 0.03]] * 50)  # all right, by little: sharper is better but for the one row that counts as wrong
    assert 0.001 < L.best_temperature(z, np.array([0, 1] * 50)) < 0.02
    assert L.best_temperature(np.zeros((5, 1)), np.zeros(5, int)) == 1
    tiny = L.best_temperature(z * 1e-8, np.array([0, 1] * 50))
    assert tiny > np.exp(-24) and abs(tiny / L.best_temperature(z, np.array([0, 1] * 50)) - 1e-8) < 1e-9  # the grid is widened
    assert L.best_temperature(z, np.array([1, 0] * 50)) > 1e3  # all wrong: no score means anything
    assert abs(L.least(np.linspace(0.5, 1, 100_000), 0.001) - 0.5005) < 1e-3 and L.least(np.full(9, 0.7), 0.001) < 0.7


def by_hand(model, text):
    """Language and score of one text from the model's numbers, piece by piece in plain Python."""
    words = "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text.lower())
    raw = words.encode("utf-8", "replace")
    raw = b" " + b" ".join(raw.split()) + b" "
    found = []
    for n, factor, plus in ((2, 0x9E3779B1, 0), (3, 0x85EBCA77, 0x27D4EB2F), (4, 0xC2B2AE3D, 0x165667B1)):
        for i in range(len(raw) - n + 1):
            found.append((int.from_bytes(raw[i : i + n], "little") * factor + plus) % 2**32 >> (32 - model.bits))
    mean = sum(model.table[b].astype(float) for b in found) / len(found)
    z = (mean if model.layer is None else mean @ model.layer) + model.bias
    e = [np.exp((x - max(z)) / model.temperature) for x in z]
    best = max(range(len(e)), key=lambda i: e[i])
    return model.languages[best], e[best] / sum(e)


def test_predictions_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = L.fit(docs, per_language=60)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in L.identify(docs, model).collect():
        lang, score = by_hand(model, text[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - min(1, score)) < 1e-6


def test_more_languages_than_dimensions():
    rng = np.random.default_rng(2)
    languages = [f"l{i:02}" for i in range(40)]
    syllables = {x: ["".join(rng.choice(list("abcdefghijklmnoprstuvwz"), 3)) for _ in range(12)] for x in languages}
    write = lambda x: " ".join("".join(rng.choice(syllables[x], 2)) for _ in range(40))
    model = L.train([write(x) for x in languages for _ in range(20)], [x for x in languages for _ in range(20)])
    assert model.layer is not None
    right = 0
    for x in languages:
        text = write(x)
        lang, score, _ = model.predict(text)
        hand = by_hand(model, text)
        assert lang == hand[0] and abs(score - min(1, hand[1])) < 1e-6
        right += lang == x
    assert right >= 38


def test_sample_is_bounded_whatever_repeats(spark):
    rows = [(i, f"text {i}", "aa") for i in range(500)] + [(7, "the same", "bb")] * 400 + [(1000 + i, f"t {i}", f"l{i % 30}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS h", "2 AS n", "3 AS id", "4 AS at")
    texts, langs = L.sample(df, 20, "doc_id", "text", "lang")
    assert langs.count("aa") == 20 and langs.count("bb") <= 1 and len(set(langs)) >= 29
    assert (texts, langs) == L.sample(df.repartition(7), 20, "doc_id", "text", "lang")
    assert len(L.sample(df, 20, "doc_id", "text", "lang", most_rows=64)[0]) <= 64


def test_long_texts_part_by_part(monkeypatch):
    text = "some words of a text " * 40
    whole = np.sort(L.subwords(text))
    monkeypatch.setattr(L, "AT_A_TIME", 105)
    parts = list(L.spelled(text))
    assert len(parts) == 8 and b"".join(bytes(p.astype(np.uint8))[1:] for p in parts) == text.encode()
    assert len(whole) - len(L.subwords(text)) == 7 * 3  # only pieces across a cut are gone
    assert sum(len(p) for p in L.spelled("x" * 1000)) == 1000 + 2 * 10


def test_bytes_that_are_not_text_and_clashing_columns(spark):
    docs = spark.sql("SELECT 1L doc_id, CAST(X'74686520646F67FF' AS STRING) text, 'x' AS wanted, CAST(X'FF' AS STRING) AS rejected UNION ALL SELECT 2L, NULL, NULL, NULL")
    model = L.train(["the dog and the cat"] * 20 + ["der hund und die katze"] * 20, ["en"] * 20 + ["de"] * 20)
    assert L.identify(docs, model).where("doc_id = 1").first().lang_pred == "en"
    kept = L.filter_texts(docs, lambda t: t is not None)
    assert kept.selectExpr("doc_id", "hex(text) AS t", "hex(rejected) AS r").collect() == [(1, "74686520646F67FF", "FF")]
