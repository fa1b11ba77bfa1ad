"""J2, G1, G2, T6 on literal graphs and against an independent closure."""

from pyspark.sql import functions as F

from tokscope.operators.mergegraph import (
    closure_adjacency,
    closure_to_text,
    merge_closure,
    merge_edges,
)


def _tables(spark, tokens, merges):
    vocab = spark.createDataFrame([(i, t, False) for i, t in enumerate(tokens)], "token_id int, token string, special boolean")
    m = spark.createDataFrame([(r, a, b) for r, (a, b) in enumerate(merges, start=1)], "rank int, left string, right string")
    return vocab, m


def _named(spark, vocab, closure):
    names = {r.token_id: r.token for r in vocab.collect()}
    out = {}
    for r in closure_adjacency(closure).collect():
        out[names[r.ancestor]] = {names[d] for d in r.descendants}
    return out


def test_literal_graph(spark):
    vocab, m = _tables(spark, ["a", "b", "c", "ab", "abc", "aa"], [("a", "b"), ("ab", "c"), ("a", "a")])
    edges, unresolved = merge_edges(m, vocab)
    assert unresolved.count() == 0
    c = merge_closure(edges)
    assert _named(spark, vocab, c) == {"a": {"aa", "ab", "abc"}, "b": {"ab", "abc"}, "c": {"abc"}, "ab": {"abc"}}


def test_unresolved_merge_reported(spark):
    vocab, m = _tables(spark, ["a", "b"], [("a", "b")])
    _, unresolved = merge_edges(m, vocab)
    assert [tuple(r) for r in unresolved.collect()] == [(1, "a", "b")]


def test_string_merge_form(spark):
    from tokscope.sources.vocab import load_merges

    doc = '{"model":{"vocab":{"a":0,"b":1,"ab":2},"merges":["a b"]}}'
    tok = spark.createDataFrame([(doc,)], "value string").select(F.parse_json("value").alias("v"))
    assert [tuple(r) for r in load_merges(tok).collect()] == [(1, "a", "b")]


def _closure_bfs(edges):
    adj = {}
    for a, d in edges:
        adj.setdefault(a, set()).add(d)
    out = set()
    for start in adj:
        seen, stack = set(), list(adj[start])
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack.extend(adj.get(x, ()))
        out |= {(start, d) for d in seen}
    return out


def test_fixture_closure_matches_bfs(spark):
    from tokscope.session import FIXTURE_TOKENIZER
    from tokscope.sources.vocab import load_merges, load_vocab, read_tokenizer

    tok = read_tokenizer(spark, FIXTURE_TOKENIZER)
    vocab, merges = load_vocab(tok), load_merges(tok)
    edges, _ = merge_edges(merges, vocab)
    e = {(r.ancestor, r.descendant) for r in edges.collect()}
    c = {(r.ancestor, r.descendant) for r in merge_closure(edges).collect()}
    assert c == _closure_bfs(e)
    # Properties: transitive, irreflexive.
    assert all(a != d for a, d in c)
    succ = {}
    for a, d in c:
        succ.setdefault(a, set()).add(d)
    assert all(succ.get(d, set()) <= succ[a] for a, d in c)


def test_closure_to_text_last_key_wins(spark):
    from tokscope.sources.vocab import vocab_with_bytes

    # Two ids decode to the same text; the one entering the graph last wins.
    tokens = ["x", "y", "xy", "z", "xz"]
    vocab, m = _tables(spark, tokens, [("x", "y"), ("x", "z")])
    edges, _ = merge_edges(m, vocab)
    c = merge_closure(edges)
    decoded = vocab_with_bytes(vocab).withColumn(
        "decoded", F.when(F.col("token").isin("y", "z"), "Q").otherwise(F.col("decoded"))
    )
    rows = {r.token: r for r in closure_to_text(c, decoded, edges).collect()}
    assert rows["Q"].token_id == 3  # "z" is first seen in merge 2, after "y" in merge 1
    assert rows["Q"].descendants == ["xz"]
    assert rows["x"].descendants == ["xy", "xz"]
