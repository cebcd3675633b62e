"""Searches, overlap joins and page layout against plain loops."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quire.operators import answering, documents, layout, mapping, overlap, reconcile, search, sinks
from quire.operators import retrieval as R


def say(rng, n, pool="abcdefgh"):
    return " ".join("".join(rng.choices(pool, k=rng.randint(1, 5))) for _ in range(n))


def test_containing_finds_every_substring(spark):
    rng = random.Random(1)
    texts = [(i, say(rng, rng.randint(0, 40))) for i in range(80)] + [(90, None), (91, ""), (92, "AbC déf"), (93, "x" * 5000)]
    patterns = [(i, "".join(rng.choices("abcd ", k=rng.randint(1, 6)))) for i in range(60)] + [(70, ""), (71, None), (72, "bC DÉ"), (73, "x" * 9), (74, "zzz"), (74, "abc")]
    got = Counter((r.pid, r.tid) for r in search.containing(spark.createDataFrame(patterns, "pid int, pattern string"), spark.createDataFrame(texts, "tid int, text string")).collect())
    want = Counter((p, t) for p, t in {(p, t) for p, x in patterns for t, y in texts if x and y and x.lower() in y.lower()})
    assert got == want and len(want) > 500


def test_corrective_retrieval_asks_weak_questions_again(spark):
    docs = spark.createDataFrame([(1, "apple banana cherry cherry"), (2, "cherry dates dates"), (3, "dates elder elder"), (4, "fig grape"), (5, None)], "doc int, text string")
    asked = spark.createDataFrame([(1, "apple"), (2, "fig grape"), (3, "nothing known"), (4, "elder")], "qid int, text string")
    seen = []

    def rewrite(weak, hits, docs):
        seen.append(sorted(r.qid for r in weak.collect()))
        return weak.filter("qid <> 4").withColumn("text", F.concat("text", F.lit(" cherry"))).unionByName(weak.filter("qid = 4").withColumn("text", F.upper("text")))

    rows = search.corrective(asked, docs, 3, 1, 1.5, 3, rewrite).collect()
    first = {r.qid: r.best for r in R.bm25(asked, docs, 3).groupBy("qid").agg(F.max("score").alias("best")).collect()}
    weak = sorted(q for q in (1, 2, 3, 4) if first.get(q, 0) < 1.5)
    assert seen[0] == weak and 3 in weak and 4 not in sum(seen[1:], [])  # 4 came back as it was, but for its case
    hops = {r.qid: r.hops for r in rows}
    assert all(hops[q] == 1 for q in hops if q not in weak or q == 4) and hops[3] >= 2
    assert {r.doc for r in rows if r.qid == 3} == {1, 2}
    by = defaultdict(list)
    for r in rows:
        by[r.qid].append((r["rank"], r.score))
    assert all([x for x, _ in sorted(v)] == [*range(1, len(v) + 1)] and [s for _, s in sorted(v)] == sorted((s for _, s in v), reverse=True) for v in by.values())


def test_feedback_adds_words_of_the_best_documents(spark):
    docs = spark.createDataFrame([(1, "apple rare rare"), (2, "apple common"), (3, "common common"), (4, "common")], "doc int, text string")
    weak = spark.createDataFrame([(1, "apple"), (2, "absent")], "qid int, text string")
    out = {r.qid: r.text for r in search.feedback_queries(weak, R.bm25(weak, docs, 5), docs, 2, 1).collect()}
    assert out == {1: "apple rare"}


def test_graph_chunks_are_capped_and_ordered(spark):
    entities = [(d, None, f"goda rajesh {d}", "x") for d in range(20)] + [(30, 2, None, "INV-0065"), (31, 0, None, "inv-0065b"), (99, 0, None, "INV-0065")]
    chunks = [(d, i) for d in [*range(20), 30, 31] for i in range(3)]
    asked = [(1, "What of Rajesh and INV-0065?"), (2, "the document of page value"), (3, None), (4, "RAJ")]
    frames = spark.createDataFrame(asked, "qid int, text string"), spark.createDataFrame(entities, "doc int, idx int, canonical string, text string"), spark.createDataFrame(chunks, "doc int, idx int")
    got = defaultdict(list)
    for r in sorted(search.graph_chunks(*frames, documents=4, pool=10).collect(), key=lambda r: (r.qid, r.pos)):
        got[r.qid].append((r.doc, r.idx))
    whole = [(d, i) for d in range(4) for i in range(3)]
    assert got == {1: [(30, 2), (31, 0), *whole][:10], 4: whole[:10]}


def test_keyword_sources_have_their_priority(spark):
    docs = [(1, "lease.pdf", "lease", '{"a": "lease"}'), (2, "b.pdf", "lease deed", '{"a": "lease"}'), (3, "c.pdf", "bill", '{"a": "LEASE"}'), (4, "d.pdf", None, None), (5, None, None, None), (6, "f", "g", "h")]
    chunks = [(1, 0, "lease"), (4, 0, "nothing"), (4, 1, "the Lease of old"), (5, 0, "term of lease term"), (6, 0, "leas e")]
    asked = [(1, " lease "), (2, "old lease"), (3, ""), (4, None)]
    out = search.keyword_documents(spark.createDataFrame(asked, "qid int, text string"), spark.createDataFrame(docs, "doc int, name string, kind string, fields string"), spark.createDataFrame(chunks, "doc int, idx int, text string")).collect()
    got = {(r.qid, r.doc): (r.source, r.score) for r in out}
    assert len(got) == len(out) and {k: v for k, v in got.items() if v[1] >= 8} == {(1, 1): ("name", 10.0), (1, 2): ("kind", 8.0), (1, 3): ("fields", 9.0)}
    assert {k for k, v in got.items() if v[0] == "text"} == {(1, 4), (1, 5), (2, 4)} and all(0 < v[1] < 2 for v in got.values() if v[0] == "text")


def test_intervals_and_boxes_meet_once(spark):
    rng = random.Random(4)
    ints = lambda n: [(rng.randrange(3), i, a := rng.randrange(200), a + rng.randrange(-1, 60)) for i in range(n)]
    l, r = ints(120), ints(120)  # noqa: E741
    frames = spark.createDataFrame(l, "k int, a int, a0 int, a1 int"), spark.createDataFrame(r, "k int, b int, b0 int, b1 int")
    want = {(x[1], y[1]) for x in l for y in r if x[0] == y[0] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]}
    for span in (1, 7, 1000):
        got = Counter((x.a, x.b) for x in overlap.interval_overlaps(*frames, ["k"], span).collect())
        assert got == Counter(want) and want
    boxes = lambda n: [(rng.randrange(2), i, x := rng.uniform(-9, 50), y := rng.uniform(-9, 50), x + rng.uniform(-1, 20), y + rng.uniform(-1, 20)) for i in range(n)] + [(0, n, 1.0, 1.0, None, 2.0), (0, n + 1, 5.0, 5.0, 5.0, 5.0)]
    l, r = boxes(90), boxes(90)  # noqa: E741
    ok = lambda b: None not in b and b[2] <= b[4] and b[3] <= b[5]
    want = {(a[1], b[1]) for a in l for b in r if a[0] == b[0] and ok(a) and ok(b) and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]}
    names = lambda s: f"k int, {s} int, {s}x0 double, {s}y0 double, {s}x1 double, {s}y1 double"
    for w, h in ((3.0, 50.0), (100.0, 1.0)):
        got = Counter((x.a, x.b) for x in overlap.box_overlaps(spark.createDataFrame(l, names("a")), spark.createDataFrame(r, names("b")), ["k"], w, h).collect())
        assert got == Counter(want) and len(want) > 200


def test_annotated_chunks_know_their_blocks(spark):
    rng = random.Random(5)

    def text():
        parts = [say(rng, 6)] if rng.random() < 0.5 else []
        for k in range(rng.randint(0, 12)):
            parts.append(f"<!-- block:b_{k:04} -->" + rng.choice(["", "  ", say(rng, rng.randint(1, 60)), f"\n{say(rng, 4)}\n\n{say(rng, 5)}\n"]))
        return "".join(parts)

    texts = [text() for _ in range(30)] + [None, "", "no mark", "<!-- block:x --> y"]
    want = []
    for i, t in enumerate(texts):
        parts = re.split(r"<!-- block:(b_\w+) -->", t or "")
        segments = [(b, documents.nfkc(x.strip())) for b, x in [(None, parts[0]), *zip(parts[1::2], parts[2::2])] if x.strip()]
        starts, at = [], 0
        for _, x in segments:
            starts.append(at)
            at += len(x) + 2
        for k, (_, a, b) in enumerate(documents.pack("\n\n".join(x for _, x in segments), 120, 30)):
            want.append((i, k, a, b, [n for (n, x), s in zip(segments, starts) if n and a < s + len(x) and b > s]))
    df = spark.createDataFrame([*enumerate(texts)], "id int, text string")
    got = sorted((r.id, r.idx, r.a0, r.a1, r.blocks) for r in overlap.annotated_chunks(df, "id", "text", 120, 30).collect())
    assert got == sorted(want) and any(len(w[4]) > 2 for w in want)


def test_chunks_find_their_lines(spark):
    rng = random.Random(6)
    lines, chunks, want = [], [], {}
    for page in range(6):
        own = [(k, k / 20, 0.05, rng.choice(["", "ab", "Total due", say(rng, 5), None])) for k in range(20)]
        lines += [(page, *x) for x in own]
        for c in range(8):
            kind = rng.choice(["text", "table"])
            part = rng.sample([x[3] for x in own if x[3]], 3)
            body = rng.choice([f" {part[0].upper()} and {part[1]}", "", None, "nothing here ab"])
            y0, y1 = rng.choice([(None, None), (0.5, 0.4), (0.31, 0.42), (0.0, 0.1), (-0.1, 0.2)])
            chunks.append((page, c, kind, body, y0, y1))
            full = [x for x in own if x[3]]
            if kind == "table":
                hit = [x[0] for x in full if y0 is not None and 0 <= y0 < y1 and x[1] + x[2] >= max(0, y0 - 0.02) and x[1] <= min(1, y1 + 0.02)] or [x[0] for x in full]
            else:
                hit = [x[0] for x in full if body and body.strip() and x[3].lower() in body.strip().lower()]
            want[page, c] = hit or None
    got = overlap.lines_of_chunks(spark.createDataFrame(chunks, "page int, chunk int, kind string, text string, y0 double, y1 double"), spark.createDataFrame(lines, "page int, line int, y0 double, h double, text string"))
    assert {(r.page, r.chunk): r.lines for r in got.collect()} == want


def plainly_located(texts, value):
    """First place of a value among words, by loops: (first, last) or None."""
    norm = [re.sub(r"[^\w]+", "", t.lower()) for t in texts]
    joined, tokens = re.sub(r"[^\w]+", "", value.lower()), [t for t in re.split(r"[^\w]+", value.lower()) if t]
    if len(joined) >= 3 and joined in norm:
        return norm.index(joined), norm.index(joined)
    m = len(tokens)
    if not m or m > len(norm):
        return None
    for off in (0, 1) if m >= 3 else (0,):
        for i in range(len(norm) - m + 1):
            if sum(norm[i + j] != tokens[j] for j in range(m)) <= off:
                return i, i + m - 1
    for i in range(len(norm) - 1) if m >= 2 else ():
        if norm[i : i + 2] == tokens[:2]:
            return i, i + 1
    return None


def test_values_are_located_as_by_loops(spark):
    rng = random.Random(7)
    pool = ["GODA", "Rajesh", "1987-01-16", "the", "fox,", "snacks", "S1234567A", "é.b", "--", "a", "10"]
    pages = {p: [rng.choice(pool) for _ in range(rng.choice([3, 40, 3000]))] for p in range(12)} | {50: []}
    values = [(p, f"f{k}", rng.choice(["-", " ", ", "]).join(rng.choice(pool + ["wrong"]) for _ in range(rng.randint(1, 5)))) for p in pages for k in range(25)]
    values += [(0, "empty", " "), (0, "null", None), (0, "mark", "--"), (77, "nowhere", "goda")]
    words = [(p, n, t, n * 10.0, n // 10 * 12.0, n * 10.0 + 8, n // 10 * 12.0 + 9) for p, ts in pages.items() for n, t in enumerate(ts)]
    got = layout.located(spark.createDataFrame(words, "page int, n int, text string, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(values, "page int, field string, value string"))
    want = {(p, f): plainly_located(pages.get(p, []), v or "") for p, f, v in values}
    want = {k: v for k, v in want.items() if v}
    rows = got.collect()
    assert {(r.page, r.field): (r["first"], r["last"]) for r in rows} == want and len(want) > 60
    assert all((r.x0, r.x1, r.y0) == (r["first"] * 10.0, r["last"] * 10.0 + 8, r["first"] // 10 * 12.0) for r in rows)


def test_two_columns_are_read_one_after_the_other(spark):
    """A page with a banner, headings on either side and a word across the gutter; a table and a single column stay out."""
    def line(page, y, x, text):
        out = []
        for w in text.split():
            out.append((page, x, float(y), x + 5.0 * len(w), y + 10.0, w))
            x += 5.0 * len(w) + 5
        return out

    words = line(1, 0, 20.0, "banner" * 16)
    for k in range(12):
        y = 20 + 14 * k
        words += line(1, y + k % 2, 20.0, "SKILLS NOW" if k in (0, 6) else f"left {k} words") + line(1, y, 330.0, "EDUCATION" if k in (1, 7) else f"right{k}here")
    for k in range(12):
        words += line(2, 14 * k, 20.0, "HEAD A" if k < 3 else f"name {k}") + line(2, 14 * k, 330.0, "RESULT UNITS" if k < 3 else f"value {k}")
        words += line(3, 14 * k, 20.0 + 3.0 * k, "onewordhere column " * 5)
        words += line(4, 14 * k, 20.0, f"left {k}") + line(4, 14 * k, 330.0, f"right{k}")
    df = spark.createDataFrame(words, "page int, x0 double, y0 double, x1 double, y1 double, text string")
    gutters = {r.page: r for r in layout.gutters(layout.rows(df), 600.0).collect()}
    assert set(gutters) == {1, 2, 4} and (gutters[1].split, gutters[1].crossing, gutters[1]["rows"]) == (12, 1, 13)
    read = defaultdict(list)
    for r in sorted(layout.columns(df, 600.0).collect(), key=lambda r: (r.page, r.pos)):
        read[r.page].append((r.side, r.text))
    left = [(1, "SKILLS NOW" if k in (0, 6) else f"left {k} words") for k in range(12)]
    right = [(2, "EDUCATION" if k in (1, 7) else f"right{k}here") for k in range(12)]
    assert read == {1: [(0, "banner" * 16), *left, *right]}
    assert {r.page for r in layout.columns(df, 600.0, headings=0).collect()} == {1, 4}


@pytest.mark.parametrize("empty", ["", None])
def test_nothing_is_found_in_nothing(spark, empty):
    words = spark.createDataFrame([], "page int, n int, text string, x0 double, y0 double, x1 double, y1 double")
    assert layout.located(words, spark.createDataFrame([(1, "f", empty)], "page int, field string, value string")).count() == 0
    assert layout.columns(words, 600.0).count() == 0
    assert search.containing(spark.createDataFrame([(1, empty)], "pid int, pattern string"), spark.createDataFrame([(1, "x")], "tid int, text string")).count() == 0


def test_the_first_handler_that_answers_wins(spark):
    asked = spark.createDataFrame([(1, "how many lost"), (2, "how many found"), (3, "total found"), (4, "nothing"), (5, None)], "qid int, text string")
    seen = {}

    def handler(name, word):
        def run(q):
            seen[name] = sorted(r.qid for r in q.select("qid").collect())
            return q.select("qid", F.when(F.contains("text", F.lit(word)), F.lit(name)).alias("answer"))

        return run

    has = lambda w: F.coalesce(F.contains("text", F.lit(w)), F.lit(False))
    handlers = [("count", has("many"), handler("count", "found")), ("any", F.col("text").isNotNull(), handler("any", "o")), ("never", F.lit(False), lambda q: 1 / 0), ("last", F.lit(None).cast("boolean"), lambda q: 1 / 0)]
    got = {r.qid: (r.handler, r.answer) for r in answering.answer_chain(asked, handlers).collect()}
    assert got == {1: ("any", "any"), 2: ("count", "count"), 3: ("any", "any"), 4: ("any", "any"), 5: (None, None)}
    assert seen == {"count": [1, 2], "any": [1, 3, 4]}
    assert {r.handler for r in answering.answer_chain(asked, handlers[2:]).collect()} == {None}


def test_chunks_are_replaced_and_a_second_run_leaves_every_file(spark, tmp_path):
    path, kind = f"file://{tmp_path}/out", "doc int, idx int, text string"
    docs = spark.createDataFrame([(i,) for i in range(30)], "doc int")
    chunks = spark.createDataFrame([(i, k, f"{i} {k}") for i in range(29) for k in range(3)], kind)
    files = lambda: {(p, p.stat().st_mtime_ns) for p in tmp_path.rglob("*.parquet")}
    read = lambda: Counter((r.doc, r.idx, r.text) for r in spark.read.schema(kind).parquet(path).collect())
    n = sinks.write_chunks(docs, chunks, path, 8)
    assert 6 <= n <= 8 and read() == Counter(map(tuple, chunks.collect()))
    before = files()
    assert sinks.write_chunks(docs, chunks.repartition(5), path, 8) == 0 and files() == before
    some = spark.createDataFrame([(3,), (4,), (50,)], "doc int")
    more = spark.createDataFrame([(3, 0, "new"), (50, 0, "late"), (7, 0, "not asked")], kind)
    assert 1 <= sinks.write_chunks(some, more, path, 8) <= 3
    want = Counter(x for x in map(tuple, chunks.collect()) if x[0] not in (3, 4)) + Counter([(3, 0, "new"), (50, 0, "late")])
    assert read() == want and len(before & files()) >= n - 3
    assert sinks.write_chunks(docs.unionByName(some), chunks.limit(0), path, 8) >= n and not list(tmp_path.rglob("*.parquet"))


def test_a_run_takes_the_place_of_the_run_before(spark):
    kind = "kind string, src int, dst int, confidence double"
    earlier = spark.createDataFrame([("d", 1, 2, 0.5, "confirmed"), ("d", 1, 3, 0.5, "proposed"), ("d", 2, 3, 0.5, "confirmed"), ("p", 1, 2, 0.5, "rejected")], f"{kind}, status string")
    found = spark.createDataFrame([("d", 1, 2, 0.9), ("d", 4, 5, 0.8), ("p", 1, 2, 0.7)], kind)
    got = {tuple(r) for r in reconcile.replace_run(earlier, found).collect()}
    assert got == {("d", 1, 2, 0.9, "confirmed"), ("d", 2, 3, 0.5, "confirmed"), ("d", 4, 5, 0.8, "proposed"), ("p", 1, 2, 0.7, "proposed")}


def test_records_of_any_shape_are_mapped_and_earlier_runs_deprecated(spark):
    docs = [
        (1, '{"seller": {"name": "Acme Bank Ltd", "city": "not read"}, "title": "Mr. Skip Me", "total_amount": "S$1,200.50", "n": 5, "notes": {"deep": {"issuer_address": " 1 Main St "}}}'),
        (2, '{"holder": "Alder Quinn / Mara Voss", "rows": [{"sku_number": "A-1 b"}, {"due": "12/05/2026"}, ["lost"], 7, null], "owners": ["Bo Lee", "x", ""], "buyer": {"name": 7, "value": "Cy Dee"}}'),
        (3, "broken {"), (4, None), (5, "[]"), (6, '{"vendor": "N/A", "party": {"name": " ", "value": null, "seller": "Di Eff"}}'),
    ]
    df = spark.createDataFrame(docs, "doc int, fields string")
    found = mapping.entities(mapping.leaves(df))
    got = {(r.doc, r.kind, r.canonical, tuple(r.roles)) for r in found.collect()}
    assert got == {
        (1, "org", "acme bank", ("seller",)), (1, "money", "1200.50 SGD", ("total_amount",)), (1, "location", "1 main st", ("issuer_address",)),
        (2, "person", "alder quinn", ("holder",)), (2, "person", "mara voss", ("holder",)), (2, "identifier", "a1b", ("sku_number",)), (2, "date", "2026-12-05", ("due",)),
        (2, "person", "bo lee", ("owners",)), (2, "person", "cy dee", ("buyer",)), (6, "person", "di eff", ("seller",)),
    }
    assert {(r.doc, r.rel) for r in mapping.relations(found).filter("doc = 1").collect()} == {(1, "is_party_to"), (1, "has_total"), (1, "governed_by")}
    none = found.withColumn("run", F.lit(1)).withColumn("deprecated_by", F.lit(None).cast("int")).limit(0)
    one = mapping.refreshed(none, df, found, 1)
    two = mapping.refreshed(one, df.filter("doc = 6"), found.filter("doc = 6"), 2)
    three = {(r.doc, r.run, r.deprecated_by) for r in mapping.refreshed(two, df.filter("doc IN (5, 6)"), found.limit(0), 3).collect()}
    assert three == {(1, 1, None), (2, 1, None), (6, 1, 2), (6, 2, 3)}
