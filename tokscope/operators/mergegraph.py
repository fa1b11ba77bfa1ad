"""Merge graph of a BPE vocabulary.

The graph is bounded by the vocabulary (two edges per merge), never by
the corpus. Joins against ``vocab`` are broadcast after a size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokscope.session import bounded_broadcast, cut_columns

MAX_CLOSURE_ROUNDS = 100
#: Rounds of a closure after which each is looked through for new pairs, that is paths of more than 15 edges.
CHECK_AFTER = 3


def merge_edges(merges: DataFrame, vocab: DataFrame, vocab_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(ancestor, descendant)`` edges and the merges that did not resolve.

    For merge ``(l, r)`` both ``id(l)`` and ``id(r)`` point to ``id(l+r)``.
    Returns ``(edges, unresolved)``; the analysed program fails on the
    first unresolved merge, here they are reported as rows instead.
    Each edge carries ``order_key`` = 2 x rank (+1 for the right part), so
    the smallest key per ancestor is where it first entered the graph; the
    closure-to-text parity rule uses it.
    """
    v = vocab.select("token", "token_id")
    n = vocab_rows if vocab_rows is not None else v.count()
    lv = bounded_broadcast(v.select(F.col("token").alias("left"), F.col("token_id").alias("left_id")), known_rows=n)
    rv = bounded_broadcast(v.select(F.col("token").alias("right"), F.col("token_id").alias("right_id")), known_rows=n)
    mv = bounded_broadcast(v.select(F.col("token").alias("merged"), F.col("token_id").alias("merged_id")), known_rows=n)
    resolved = (
        merges.withColumn("merged", F.concat("left", "right"))
        .join(lv, "left", "left")
        .join(rv, "right", "left")
        .join(mv, "merged", "left")
    )
    ok = F.col("left_id").isNotNull() & F.col("right_id").isNotNull() & F.col("merged_id").isNotNull()
    good = resolved.filter(ok)
    unresolved = resolved.filter(~ok).select("rank", "left", "right")
    left_edges = good.select(
        F.col("left_id").alias("ancestor"), F.col("merged_id").alias("descendant"), (F.col("rank") * 2).alias("order_key")
    )
    right_edges = good.select(
        F.col("right_id").alias("ancestor"),
        F.col("merged_id").alias("descendant"),
        (F.col("rank") * 2 + 1).alias("order_key"),
    )
    edges = left_edges.unionByName(right_edges)
    return edges, unresolved


def require_resolved(unresolved: DataFrame, show: int = 5) -> None:
    """Raise if any merge did not resolve, naming the first few (vocabulary-sized input)."""
    rows = unresolved.orderBy("rank").limit(show).collect()
    if rows:
        named = ", ".join(f"#{r['rank']} {r['left']!r}+{r['right']!r}" for r in rows)
        raise ValueError(f"merges that the vocabulary does not hold: {named}")


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("ancestor", "descendant").distinct()


def merge_closure(edges: DataFrame, max_rounds: int = MAX_CLOSURE_ROUNDS) -> DataFrame:
    """G1: transitive closure ``(ancestor, descendant)`` with paths that double in length each round.

    A round knows the pairs ``paths`` that fewer than ``2**k`` edges join and the
    pairs ``exact`` that ``2**k`` edges join, and joins the two on the middle
    node (J3): a path is cut at one place only, so a pair is found once for each
    length of its paths and not once for each node in between. What a round
    finds is de-duplicated and written to the shared checkpoint folder so the
    plan does not grow; pairs of several rounds are de-duplicated at the end.
    Stops when no path is left that long or, after ``CHECK_AFTER`` rounds, as
    there are cycles then, when a round finds no new pair; more than
    ``max_rounds`` rounds raise, as the analysed program does.
    """
    key = ["ancestor", "descendant"]
    exact = cut_columns(distinct_edges(edges))
    # Nothing leads to these nodes, so no path is continued at them; as ancestors they may have very many pairs.
    tops = _cut_known(exact.select("ancestor").distinct().join(exact.select(F.col("descendant").alias("ancestor")).distinct(), "ancestor", "left_anti"))
    paths = exact
    for k in range(max_rounds):
        exact = cut_columns(_joined(exact, exact, tops).distinct())
        if exact.isEmpty():
            return cut_columns(paths.distinct()) if k else paths
        found = cut_columns(_joined(paths, exact, tops).unionByName(exact).distinct())
        if k >= CHECK_AFTER and found.join(paths, key, "left_anti").isEmpty():
            return cut_columns(paths.distinct())
        paths = paths.unionByName(found)
    raise ValueError(f"merge closure did not converge in {max_rounds} rounds")


def _cut_known(nodes: DataFrame) -> DataFrame:
    """Cut the lineage of a few nodes, to be joined by broadcast where they are few indeed."""
    return bounded_broadcast(cut_columns(nodes))


def _joined(front: DataFrame, behind: DataFrame, tops: DataFrame) -> DataFrame:
    """Pairs joined by a pair of ``front`` and then one of ``behind``, repeats included; ``tops`` are no descendants in ``front``."""
    behind = behind.join(tops, "ancestor", "left_anti").withColumnRenamed("ancestor", "mid")
    return front.select("ancestor", F.col("descendant").alias("mid")).join(behind, "mid").select("ancestor", "descendant")


def extend_closure(closure: DataFrame, new_edges: DataFrame, max_rounds: int = MAX_CLOSURE_ROUNDS) -> DataFrame:
    """G1 after edges were added: the pairs that ``new_edges`` add to ``closure``.

    ``closure`` must be transitively closed; the result holds none of its
    pairs, so the new closure is their union. A path with new edges is, perhaps,
    a known pair and then steps of one new edge and, perhaps, a known pair
    each: the closure of the steps is made as in :func:`merge_closure`, and known
    pairs are joined in front of it once, so they are never joined with each
    other again. Edges that the closure already holds, repeated edges and null
    ends add nothing; a cycle gives each of its nodes a pair with itself, as in
    ``merge_closure``.
    """
    key = ["ancestor", "descendant"]
    known = closure.select(key)
    fresh = cut_columns(distinct_edges(new_edges.dropna(subset=key)).join(known, key, "left_anti"))
    if fresh.isEmpty():
        return fresh
    # Where known pairs go on behind a new edge, and where they lead to one: by nodes first, as a node may have very many pairs.
    after = _cut_known(fresh.select("descendant").distinct().join(known.select(F.col("ancestor").alias("descendant")).distinct(), "descendant"))
    behind = known.join(after.withColumnRenamed("descendant", "ancestor"), "ancestor", "left_semi").withColumnRenamed("ancestor", "mid")
    steps = fresh.select("ancestor", F.col("descendant").alias("mid")).join(behind, "mid").select(key).unionByName(fresh)
    steps = merge_closure(steps, max_rounds)
    none = steps.select("ancestor").distinct().join(known.select(F.col("descendant").alias("ancestor")).distinct(), "ancestor", "left_anti")
    found = _joined(known, steps, _cut_known(none)).unionByName(steps).distinct()
    return cut_columns(found.join(known, key, "left_anti"))


def closure_adjacency(closure: DataFrame) -> DataFrame:
    """``ancestor -> sorted unique descendants``.

    A group is one ancestor's descendant set: bounded by the vocabulary.
    """
    return closure.groupBy("ancestor").agg(
        F.array_sort(F.collect_set("descendant")).alias("descendants"),
        F.count(F.lit(1)).alias("n_descendants"),
    )


def closure_to_text(
    closure: DataFrame, vocab_decoded: DataFrame, edges: DataFrame, parity: bool = True, vocab_rows: int | None = None
) -> DataFrame:
    """Closure rewritten with decoded text; ids are kept beside the text.

    Output ``(token, token_id, descendants array<string>, descendant_ids
    array<int>)`` with descendants in id order. With ``parity`` a decoded
    key shared by several ids keeps only the id that entered the graph last
    (the analysed program builds a dict, so the last write wins).
    """
    dv = vocab_decoded.select("token_id", "decoded")
    n = vocab_rows if vocab_rows is not None else dv.count()
    first_seen = edges.groupBy("ancestor").agg(F.min("order_key").alias("order_key"))
    named = (
        closure.join(
            bounded_broadcast(dv.withColumnRenamed("token_id", "descendant").withColumnRenamed("decoded", "d_text"), known_rows=n),
            "descendant",
        )
        .groupBy("ancestor")
        .agg(F.array_sort(F.collect_list(F.struct("descendant", "d_text"))).alias("ds"))
        .join(first_seen, "ancestor")
        .join(bounded_broadcast(dv.withColumnRenamed("token_id", "ancestor"), known_rows=n), "ancestor")
    )
    named = named.select(
        F.col("decoded").alias("token"),
        F.col("ancestor").alias("token_id"),
        F.transform("ds", lambda x: x["d_text"]).alias("descendants"),
        F.transform("ds", lambda x: x["descendant"]).alias("descendant_ids"),
        "order_key",
    )
    if parity:
        keep = F.max_by(F.struct("token_id", "descendants", "descendant_ids"), "order_key")
        named = named.groupBy("token").agg(keep.alias("k")).select("token", "k.*")
        return named
    return named.drop("order_key")

