"""The pipeline's stages against brute force on small tables."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, brute_components, brute_items, brute_lines, speech

import corpus_pipeline
from factloom.llm import langid


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    langs = [rng.choice(["xx", "yy", "zz"]) for _ in range(200)]
    common = speech(rng, "xx", 12)
    texts = ["\n".join(speech(rng, x, rng.randrange(10, 60)) for _ in range(rng.randrange(1, 4))) + ("\n" + common if rng.random() < 0.2 else "") for x in langs]
    for i in range(20, 40):
        texts[i] = texts[20] + f" w{i}"
    item = speech(rng, "yy", 15)
    texts[50] += " " + item
    texts += ["12 34", None, common]
    table = spark.createDataFrame([(i, t, (langs + ["xx"] * 3)[i], f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)], DOCS)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    now = table
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r for r in now.collect()}
        if name != "mixing sources":
            assert tuple(now.columns) == corpus_pipeline.COLUMNS
    first = seen["language ID"]
    assert set(first) == set(range(203)) - {200, 201}
    lines = {i: t for i, _, _, t in brute_lines([(i, r["text"]) for i, r in first.items()])}
    second = {i: t for i, t in lines.items() if t.strip()}
    assert {i: r["text"] for i, r in seen["line dedup"].items()} == second
    ids = sorted(second)
    third = {ids[i] for i, _, c in brute_components([second[i] for i in ids]) if c == i}
    assert set(seen["n-gram Jaccard join"]) == third
    fourth = {i for i in third if not brute_items(second[i], [(1, item)])[1]}
    assert set(seen["benchmark decontamination"]) == fourth and 50 not in fourth
    last = seen["mixing sources"]
    assert set(last) <= fourth and all(r["copies"] > 0 for r in last.values())
    again = {r["doc_id"]: r["copies"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert again == {i: r["copies"] for i, r in last.items()}


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0


VOCABULARY = {
    "en": "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know city country river island",
    "es": "el de que y en los se del las por un para con no una su al lo como más pero sus le ya este sí porque esta entre cuando muy sin sobre también hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos esto antes algunos unos otro otras otra tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros ciudad país capital río grande casa historia mundo",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom können schon wenn habe seine ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine uhr stadt land fluss hauptstadt größte haus",
}
UNLEARNED = {
    "fi": "Helsingin kaupunki on Suomen pääkaupunki ja sen suurin kaupunki, jossa asuu yli kuusisataatuhatta ihmistä.",
    "it": "La città di Roma è la capitale della Repubblica Italiana e il comune più popoloso del paese, ricco di storia e di arte.",
    "pl": "Warszawa jest stolicą Polski i największym miastem kraju, położonym nad rzeką Wisłą w województwie mazowieckim.",
    "sv": "Staden Stockholm är Sveriges huvudstad och ligger på flera öar där sjön möter havet, med många gamla hus.",
    "ru": "Москва — столица России и самый большой город страны, стоящий на реке.",
    "xx": "kqzv wxjq zzkp vvqx jjwk qpzx kkvj wqzz xjkv pqwz zxkq jvwq",
}


def test_language_stage_drops_unlearned_languages(spark):
    rng = random.Random(12)
    langs = [rng.choice(sorted(VOCABULARY)) for _ in range(400)]
    some = lambda x, n: " ".join(rng.choices(VOCABULARY[x].split(), k=n))
    texts = [some(x, rng.randrange(12, 120)) for x in langs]
    for i in range(0, 400, 20):  # short ones with a number and a key
        texts[i] = some(langs[i], 14) + ' +1 (545) 555-9123 token = "b64b244acde2e3b0aa8f"'
    texts += ["ja", *UNLEARNED.values(), *(" ".join([t] * 20) for t in UNLEARNED.values())]  # one is too short to tell
    table = spark.createDataFrame([(i, t, (langs + [None] * 99)[i], "s", len(t)) for i, t in enumerate(texts)], DOCS)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, table, "").collect()}
    assert set(range(401)) <= kept
    assert kept == set(range(401)), [texts[i][:30] for i in kept if i > 400]


def test_language_stage_learns_from_all_rows(spark):
    rng = random.Random(14)
    usual, rest, other = (["".join(rng.choices(letters, k=6)) for _ in range(40)] for letters in ("abcdef", "ghijkl", "mnopqr"))
    # over 4,000 training rows of xx; those that a sample by a hash of the id would leave out have words of their own
    u = F.xxhash64(F.col("id").cast("string")).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    marks = spark.range(6300).select("id", langid.held_out("id").alias("held"), u.alias("u")).collect()
    share = 4000 / sum(not r["held"] for r in marks if r["id"] < 6000)
    texts = [" ".join(rng.choices(other if r["id"] >= 6000 else rest if r["u"] > share and not r["held"] else usual, k=12)) for r in marks]
    table = spark.createDataFrame([(i, t, "xx" if i < 6000 else "yy", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    assert sum(t.split()[0] in rest for t in texts) > 300
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, table, "").collect()} == set(range(6300))


def test_low_scores_are_exact(spark):
    rng = random.Random(15)
    texts = [" ".join(rng.choices(VOCABULARY["en" if i % 3 else "de"].split(), k=rng.randrange(3, 40))) + " qx" * rng.randrange(9) for i in range(300)]
    texts += texts[:40] * 2
    table = spark.createDataFrame([(i, t, "de" if t in texts[:300:3] else "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    model = langid.train(table, profile=200)
    told = langid.identify(table, model).where("lang = lang_pred")
    for q in (0.0, 0.01, 0.37, 1.0):
        exact = {r["lang"]: r["p"] for r in told.groupBy("lang").agg(F.percentile(langid.most_likely(), F.lit(q)).alias("p")).collect()}
        for bins in (1, 50, 1 << 16):
            assert langid.low_scores(table, model, q, docs_per_language=None, bins=bins) == pytest.approx(exact, rel=1e-12)


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(13)
    a, b, c, d, e = (speech(rng, "xx", 60) for _ in range(5))
    # 5: a row given three times; 7: a copy of 2's text and a text of its own; 9, 8: near copies; null ids and texts without words stay
    rows = [(5, a)] * 3 + [(7, b), (7, c), (2, b), (9, d), (8, d + " w"), (8, e), (None, a), (None, a), (6, "")]
    table = spark.createDataFrame([(i, t, "xx", "s", len(t)) for i, t in rows], DOCS)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, table, "").collect()), key=repr)
    assert got == sorted([(5, a), (7, c), (2, b), (8, d + " w"), (8, e), (None, a), (None, a), (6, "")], key=repr)
