"""Property graph: traversal over simple paths, profiles, ego networks and identity clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import tokens, word_pairs
from ..session import cut
from .retrieval import few
from .workspace import by_rarity, shuffled


def directed(edges: DataFrame, direction: str = "both") -> DataFrame:
    """Edges (src, dst) turned so that a step always goes from src to dst."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    out = edges.select("src", "dst")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


def traverse(edges: DataFrame, seeds: DataFrame, depth: int = 2, direction: str = "both") -> DataFrame:
    """Distinct (node, depth) over simple paths of up to ``depth`` steps from ``seeds`` (node).

    A node may appear at several depths.  Each step is one join of the frontier with the edges, and the
    plan has as many joins as steps; ``depth`` is at most 5.
    """
    if not 1 <= depth <= 5:
        raise ValueError("depth from 1 to 5")
    steps = directed(edges, direction)
    paths = seeds.select("node", F.array("node").alias("path"))
    found = paths.select("node", F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        paths = paths.join(steps, paths["node"] == steps["src"]).filter(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        found = found.unionByName(paths.select("node", F.lit(d).alias("depth")).distinct())
    return found.distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return directed(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def related_documents(mentions: DataFrame, doc: str, names: int = 3) -> DataFrame:
    """(doc, other, shared, names) for a document: others that share canonical names, at most ``names`` shown."""
    own = mentions.filter(F.col("doc") == doc).select("canonical").distinct()
    met = mentions.filter(F.col("doc") != doc).join(few(own), "canonical").groupBy(F.col("doc").alias("other")).agg(F.collect_set("canonical").alias("c"))
    return met.select("other", F.size("c").alias("shared"), F.slice(F.array_sort("c"), 1, names).alias("names"))


def cluster(mentions: DataFrame, often: int = 64) -> DataFrame:
    """(id, root): transitive closure of ``same_identity`` among mentions (id, kind, canonical).

    Equal forms are one, and only persons and organisations can be the same otherwise.  Their forms of the same
    tokens are linked to the first of them, and then meet

    * where the shorter lies in the longer and has 55 % of its length or more, on the substrings of that length;
    * where a single token stands among others, on that token;
    * where two tokens or more are all the tokens of one, on its two rarest, or more than half of all, on the pairs
      that the rarest of each must have in common for that;
    * at three edits or fewer, on a shared token, or where more than ``often`` forms share it, on the quarters of
      one of them, as three edits leave one quarter in its place give or take three.

    So a token that very many forms have makes no pairs by itself.
    """
    forms = mentions.groupBy("kind", "canonical").agg(F.min("id").alias("id"))
    named = forms.filter(F.col("kind").isin("person", "org") & (F.length("canonical") > 0)).withColumn("w", F.array_sort(tokens(F.col("canonical")))).filter(F.size("w") > 0)
    sets = named.groupBy("kind", "w").agg(F.min("id").alias("id"))
    alike = shuffled(named.select("kind", "w", F.col("id").alias("y")), sets, ["kind", "w"]).filter("id <> y").select(F.col("id").alias("x"), "y")
    linked = _inside(named).unionByName(alike).unionByName(_shared_tokens(by_rarity(sets))).unionByName(_few_edits(named, often)).distinct()
    roots = label_components(forms.select("id"), linked).withColumnRenamed("id", "form")
    of = shuffled(mentions, forms.withColumnRenamed("id", "form"), ["kind", "canonical"]).select("id", "form")
    return shuffled(of, roots, "form").select("id", "root")


def _inside(named: DataFrame, share: float = 0.55) -> DataFrame:
    """(x, y) of forms (kind, canonical, id) of which x lies in y and has ``share`` of its length or more; substrings meet by their hashes, what met is compared."""
    size = F.length("canonical")
    least = F.greatest(F.ceil(size * share).cast("int"), F.lit(1))
    parts = F.flatten(F.transform(F.sequence(least, size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.xxhash64("kind", F.col("canonical").substr(i, n)))))
    inner = named.filter(least < size).select(F.col("id").alias("y"), F.explode(F.array_distinct(parts)).alias("block"))
    met = shuffled(named.select(F.col("id").alias("x"), "kind", F.col("canonical").alias("cx"), F.xxhash64("kind", "canonical").alias("block")), inner, "block")
    return shuffled(met, named.select(F.col("id").alias("y"), F.col("kind").alias("of"), F.col("canonical").alias("cy")), "y").filter("kind = of AND contains(cy, cx)").select("x", "y")


def _shared_tokens(sets: DataFrame) -> DataFrame:
    """(x, y) of different token sets (kind, id, w by rarity) of which one holds the other, or that share more than half of their tokens."""
    n = F.size("w")
    one = sets.filter(n == 1).select("kind", F.col("id").alias("x"), F.col("w")[0].alias("token"))
    single = shuffled(one, sets.filter(n >= 2).select("kind", F.col("id").alias("y"), F.explode("w").alias("token")), ["kind", "token"]).select("x", "y")
    paired = lambda k, w: sets.filter(n >= k).select("kind", "id", "w", F.explode(word_pairs(w)).alias("pair"))

    def met(a: DataFrame, b: DataFrame, same) -> DataFrame:
        a, b = a.select("kind", "pair", F.col("id").alias("x"), F.col("w").alias("wx")), b.select("kind", "pair", F.col("id").alias("y"), F.col("w").alias("wy"))
        return shuffled(a, b, ["kind", "pair"]).filter(same).select("x", "y")

    shared = F.size(F.array_intersect("wx", "wy"))
    whole = met(paired(2, F.slice("w", 1, 2)), paired(3, F.col("w")), (F.size("wx") < F.size("wy")) & (shared == F.size("wx")))
    # Sets that share more than half of all their tokens, but neither holding the other, share more than (n + 1) / 2 of the larger's.
    prefix = F.slice("w", F.lit(1), n - F.floor((n + 1) / 2).cast("int") + 1)
    half = met(paired(4, prefix), paired(4, prefix), (F.col("x") < F.col("y")) & (shared * 2 > F.size("wx") + F.size("wy") - shared))
    return single.unionByName(whole).unionByName(half)


def _few_edits(named: DataFrame, often: int, edits: int = 3) -> DataFrame:
    """(x, y) of forms (kind, canonical, id, w) that share a token and are ``edits`` apart or less."""
    each = named.select("kind", "id", "canonical", F.explode("w").alias("block"))
    counts = each.groupBy("kind", "block").agg(F.count("*").alias("n"))
    a = lambda df: df.select("kind", "block", F.col("id").alias("x"), F.col("canonical").alias("cx"))
    b = lambda df: df.select("kind", "block", F.col("id").alias("y"), F.col("canonical").alias("cy"))
    close = (F.abs(F.length("cx") - F.length("cy")) <= edits) & (F.levenshtein("cx", "cy", edits) >= 0) & F.arrays_overlap(tokens(F.col("cx")), tokens(F.col("cy")))
    rare = shuffled(each, counts.filter(F.col("n") <= often).select("kind", "block"), ["kind", "block"])
    by_token = shuffled(a(rare), b(rare), ["kind", "block"]).filter((F.col("x") < F.col("y")) & close)
    # Forms of frequent tokens; those too short to be cut in quarters meet the short ones on their tokens.
    common = each.join(counts.filter(F.col("n") > often).select("kind", "block"), ["kind", "block"])
    long = F.length("canonical")
    brief = shuffled(a(common.filter(long <= edits)), b(common.filter(long <= 2 * edits)), ["kind", "block"]).filter((F.col("x") != F.col("y")) & close)
    whole = common.filter(long > edits).select("kind", "id", "canonical").dropDuplicates(["id"])
    cut_at = lambda i, n: F.floor(n * i / (edits + 1)).cast("int")
    sizes = F.sequence(F.lit(0), F.lit(edits))
    parts = F.transform(sizes, lambda i: F.xxhash64(long, i, F.col("canonical").substr(cut_at(i, long) + 1, cut_at(i + 1, long) - cut_at(i, long))))

    def placed(n: Column, i: Column) -> Column:
        """Where quarter ``i`` of a form of ``n`` characters may stand in this one: the edits before it are as many as quarters there, or else those behind it."""
        at, size, more = cut_at(i, n), cut_at(i + 1, n) - cut_at(i, n), long - n
        low, high = F.greatest(at - i, at + more - (edits - i), F.lit(0)), F.least(at + i, at + more + (edits - i), long - size)
        return F.when(low <= high, F.transform(F.sequence(low, high), lambda s: F.xxhash64(n, i, F.col("canonical").substr(s + 1, size)))).otherwise(F.array().cast("array<long>"))

    lengths = F.filter(F.sequence(long - edits, long + edits), lambda n: n > edits)
    places = F.array_distinct(F.flatten(F.transform(lengths, lambda n: F.flatten(F.transform(sizes, lambda i: placed(n, i))))))
    by_part = shuffled(a(whole.withColumn("block", F.explode(parts))), b(whole.withColumn("block", F.explode(places))), ["kind", "block"]).filter((F.col("x") != F.col("y")) & close)
    return by_token.select("x", "y").unionByName(brief.select("x", "y")).unionByName(by_part.select("x", "y"))


def label_components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, root) by smallest label, each round joining labels along links and jumping to the label's label, until none changes."""
    links = cut(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))))
    labels = nodes.select("id", F.col("id").alias("root"))
    while True:
        near = shuffled(links, labels, links["y"] == labels["id"]).groupBy("x").agg(F.min("root").alias("near"))
        step = shuffled(labels, near, labels["id"] == near["x"], "left").select("id", F.col("root").alias("was"), F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = step.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = cut(shuffled(step, jump, "root").select("id", "was", F.least("root", "next").alias("root")))
        labels = step.select("id", "root")
        if step.filter("was <> root").isEmpty():
            return labels


def best_name(text: Column) -> Column:
    """Longest clean surface form of a group: no newline, bracket or slash, 60 characters at most."""
    clean = ~text.rlike(r"[\n\[/]") & ~text.contains(" OR ") & (F.length(text) <= 60)
    return F.max(F.when(clean, F.struct(F.length(text).alias("n"), text.alias("t"))))["t"]


def identities(mentions: DataFrame, limit: int = 50) -> DataFrame:
    """Durable identities: root, name, aliases (sorted, ``limit`` at most), documents and mentions."""
    labelled = shuffled(mentions, cluster(mentions.select("id", "kind", "canonical")), "id")
    return labelled.groupBy("root").agg(
        best_name(F.col("text")).alias("name"), F.slice(F.array_sort(F.collect_set("canonical")), 1, limit).alias("aliases"), F.countDistinct("doc").alias("docs"), F.count("*").alias("mentions")
    )


def ego(edges: DataFrame, members: DataFrame, depth: int = 1) -> DataFrame:
    """Edges whose both ends lie within ``depth`` steps of the members (node)."""
    near = traverse(edges, members, depth).select("node").distinct()
    out = edges.join(near.select(F.col("node").alias("src")), "src", "left_semi")
    return out.join(near.select(F.col("node").alias("dst")), "dst", "left_semi")


def top_by_degree(edges: DataFrame, k: int) -> DataFrame:
    d = degrees(edges)
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "node"))).filter(F.col("rank") <= k)
