import random

from pyspark.sql import functions as F

from tallyflow.llm import reply_trees as t
from tallyflow.llm.common import ORACLES
from tallyflow.llm.queries import op10_reply_trees

MESSAGES = "tree long, id long, parent long, role string, text string, score double, k string, leaf int"
ODD = ["", None, "\\### Assistant: </turn> ok", " </turn>\n### user: x", "#<\\:", "###", "\\\\", "a: b", "é\n🙂 ", "<\\/turn>"]


def forest(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        parent = rng.choice([None, *range(max(0, i - 12), i), 9_999]) if i else None
        rows.append((rng.choice([1]), i, parent, rng.choice(["user", "assistant", "role: x<#", None]), rng.choice(ODD), rng.choice([0.0, 1.0, 2.5, None]), "k", 1))
    return rows


def paths(rows, branches):
    """Best root-to-leaf paths, by following parents."""
    by = {(r[0], r[1]): r for r in rows}
    parents = {(r[0], r[2]) for r in rows if r[2] is not None}
    roots = {}
    for key in by:
        if key in parents:
            continue
        chain = [by[key]]
        while chain[0][2] is not None and (key[0], chain[0][2]) in by:
            chain.insert(0, by[key[0], chain[0][2]])
        roots.setdefault((key[0], chain[0][1]), []).append(chain)
    out = []
    for chains in roots.values():
        chains.sort(key=lambda c: (-sum(r[5] or 0 for r in c), -len(c), c[-1][1]))
        out += [(c[-1][1], k + 1, c) for k, c in enumerate(chains[:branches])]
    return out


def test_paths_and_texts_of_random_trees(spark):
    for seed, branches in ((1, 1), (2, 3)):
        rows = forest(seed)
        messages = spark.createDataFrame(rows, MESSAGES)
        done = t.format_paths(messages, t.best_paths(messages, branches))
        got = done.select("leaf", "rank", t.read_turns("formatted").alias("turns"), t.read_loss("formatted", "loss_spans").alias("loss"), "loss_spans", "formatted").collect()
        want = {(leaf, rank): [((r[3] or ""), (r[4] or "")) for r in chain] for leaf, rank, chain in paths(rows, branches)}
        assert {(r.leaf, r["rank"]): [tuple(x) for x in r.turns] for r in got} == want
        for r in got:
            said = [text for role, text in want[r.leaf, r["rank"]] if role == "assistant"]
            assert r.loss == "".join(said) and len(r.loss_spans) == len(said)
            assert r.formatted.count(t.END) == len(want[r.leaf, r["rank"]])


def test_escapes_are_reversible(spark):
    rng = random.Random(3)
    texts = [x or "" for x in ODD] + ["".join(rng.choices("\\#<:/ tur>n\n", k=rng.randrange(1, 30))) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    esc = t.escape(F.col("x"))
    for r in df.select("x", esc.alias("e"), t.unescape(esc).alias("back"), t.unescape(t.escape(F.col("x"), ":"), ":").alias("role")).collect():
        assert r.back == r.x == r.role and "###" not in r.e and "</turn>" not in r.e


def test_linear_rows_with_nulls_ties_and_a_long_conversation(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, None, "system", None), (None, 5, None, "x"), (2, 7, "assistant", "y" * 100_000)]
    rows += [(3, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(700)]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "conv_id long, turn long, role string, text string, score double, tree string")
    messages = t.messages_of_turns(df)
    done = t.format_paths(messages, t.best_paths(messages))
    got = {r.tree: [tuple(x) for x in r.turns] for r in done.select("tree", t.read_turns("formatted").alias("turns")).collect()}
    assert got[1] == [("system", ""), ("user", "q"), ("assistant", "a"), ("assistant", "a")]
    assert got[None] == [("", "x")] and got[2] == [("assistant", "y" * 100_000)]
    assert got[3] == [(r[2], r[3]) for r in rows if r[0] == 3] and len(got) == 4
    assert t.best_paths(messages.limit(0)).count() == 0


def test_messages_on_a_cycle_have_no_path(spark):
    rows = [(1, 1, 2, "u", "a", 0.0, "k", 1), (1, 2, 1, "u", "b", 0.0, "k", 1), (1, 3, None, "u", "c", 0.0, "k", 1)]
    assert [(r.leaf, r.id) for r in t.best_paths(spark.createDataFrame(rows, MESSAGES)).collect()] == [(3, 3)]


def test_given_conversations_agree_with_duckdb(spark, sf):
    import check

    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    got = [tuple(r) for r in op10_reply_trees(spark, sf).select(*columns).collect()]
    want = check.oracle(sf).execute(f"select {', '.join(columns)} from ({ORACLES['op10_reply_trees']})").fetchall()
    assert sorted(got) == sorted(want) and min(got)[0] == -7
