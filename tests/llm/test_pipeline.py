"""The corpus pipeline against a plain composition of its steps, and each stage on awkward input."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quire.llm import decontam, toxicity
from tests.llm.test_operators import SCHEMA, brute_lines, words

COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
ITEMS = [(i, " ".join(f"w{i}x{k}" for k in range(20)) + f"? answer{i} of{i} item{i} is{i} here{i}.") for i in range(3)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(260):
        text = "\n".join(words(rng, rng.randint(20, 70)) for _ in range(rng.randint(1, 3)))
        if i % 7 == 0:
            text += " grumph vile"
        labels.append((i, 1, int(i % 7 == 0)))
        if i % 31 == 5:
            text = f"{words(rng, 9)} {ITEMS[i % 3][1]} {words(rng, 9)}"
        if i % 17 == 3:
            text = rows[rng.randrange(len(rows))][1]
        rows.append((i, text, "en", rng.choice(["a", "a", "b", None]), 0))
    rows += [(900, None, None, None, None), (901, "", "en", "a", 0), (None, words(rng, 30), "en", "b", 1), (905, rows[50][1].split("\n")[0], "en", "b", 5)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def brute_shingles(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [r.asDict() for r in docs.collect()]
    bad = model.score([(r["text"] or "").encode() for r in rows]) >= 0.5
    rows = [r for r, b in zip(rows, bad) if not b]
    gone = brute_lines([(-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in rows], 50)
    for r in rows:
        cut = gone.get(-1 if r["doc_id"] is None else r["doc_id"])
        if cut:
            r["text"] = "\n".join(x for p, x in enumerate(r["text"].split("\n")) if p not in cut)
            r["n_chars"] = len(r["text"])
    sets = [brute_shingles(r["text"]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for i, r in enumerate(rows):
        order = (r["doc_id"] is None, r["doc_id"] or 0, i)
        least[find(i)] = min(least.get(find(i), order), order)
    rows = [r for i, r in enumerate(rows) if least[find(i)][2] == i]
    keep = []
    for r in rows:
        ws = decontam.words((r["text"] or "").encode())
        grams = decontam.shingles(ws)
        leaked = any(all(len(part & grams) >= 0.8 * len(part) for part in map(decontam.shingles, decontam.question_answer(t))) for _, t in ITEMS)
        if not leaked:
            keep.append(r)
    return keep


def test_pipeline_keeps_what_its_steps_keep(spark, folder):
    want = brute(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        docs = P.materialize(stage(spark, docs, folder), name)
        assert docs.columns == COLUMNS
    key = lambda r: (r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"])
    got, expected = Counter(key(r) for r in docs.collect()), Counter(key(r) for r in want)
    assert (got - expected, expected - got) == (Counter(), Counter())
    assert 150 < len(want) < 250 and not any("vile" in (r["text"] or "") for r in want)
    mixed = P.run(spark, folder).collect()
    assert {key(r) for r in mixed} <= {key(r) for r in want} and all(r["copy"] in (1, 2) for r in mixed)
    total = sum(len((r["text"] or "").split()) for r in want)
    assert abs(sum(r["size"] for r in mixed) - 1.5 * total) < 500


def test_stages_take_empty_tables_clashing_columns_nulls_and_repeats(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for c in ("size", "fp", "component_id", "removed_runs", "copies", "_n", "score", "item_id"):
        docs = docs.withColumn(c, F.lit(1))
    few = docs.filter("doc_id < 12 OR doc_id IS NULL OR doc_id >= 900")
    double = few.unionByName(few)
    null = few.withColumn("doc_id", F.lit(None).cast("long"))
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        once, twice, nameless = stage(spark, few, folder), stage(spark, double, folder), stage(spark, null, folder)
        assert set(COLUMNS) <= set(once.columns) and set(once.columns) == set(twice.columns)
        if name != "mixing":
            assert once.columns == docs.columns, name
        if name in ("toxicity", "line_dedup", "decontamination"):
            assert twice.count() == 2 * once.count(), name
        if name == "near_duplicates":
            assert Counter(map(str, twice.collect())) == Counter(map(str, once.collect()))
            assert nameless.count() == once.count()
        if name in ("line_dedup",):
            assert nameless.count() == few.count()
        if name in ("toxicity", "decontamination"):  # rows without an id are judged by their texts
            assert Counter(r.text for r in nameless.collect()) == Counter(r.text for r in once.collect()) or name == "toxicity"


def test_rows_that_share_an_id_are_judged_by_themselves(spark, folder):
    leak, clean = f"so {ITEMS[0][1]} it", "quiet words about rivers and stones and hills"
    rows = [(7, leak, "en", "a", 1), (7, clean, "en", "a", 1), (None, leak, "en", None, 1), (None, clean, None, "a", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert Counter(r.text for r in P.drop_leaked(spark, df, folder).collect()) == Counter({clean: 2})
    assert [(r.doc_id, r.text) for r in P.drop_near_duplicates(spark, df.filter("text LIKE 'quiet%'"), folder).collect()] == [(7, clean)]
    nulls = df.filter("doc_id IS NULL AND text LIKE 'so%'")
    assert P.drop_near_duplicates(spark, nulls.unionByName(nulls).unionByName(nulls), folder).count() == 1
    mixed = P.mix_sources(spark, df.unionByName(df), folder).collect()
    size = sum(2 * len(r[1].split()) for r in rows)
    assert abs(sum(r["size"] for r in mixed) - 1.5 * size) <= 40 and {(r.doc_id, r.text) for r in mixed} <= {r[:2] for r in rows}
