import hashlib
import random
from collections import defaultdict

import pytest

from helpers import rows_of
from plume.llm import chat as H


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t[5] for t in turns if t[3] == "assistant")
        out.append((conv, len(turns), sha("".join(f"{t[3]}\n{t[5]}\n" for t in turns)), len(loss), sha(loss)))
    return sorted(out, key=str)


def test_round_trip_with_control_strings_nulls_and_repeats(spark):
    r = random.Random(2)
    bits = ["</s>", "<s>", "[INST] ", " [/INST]", "&amp;", "&", "<<", ">>", "é🙂", "\n", "ok", "&lt;", "&#91;", "\\", " ", "$1"]
    text = lambda: r.choice([None, "", "".join(r.choice(bits) for _ in range(r.randint(0, 8)))])
    roles = ["user", "assistant", "system", "a>>b", "<<", "[INST] ", None, "", "tool"]
    rows = [(r.choice([1, 2, 3, None, -5]), r.choice([0, 1, 2, 3, None]), r.choice(roles), text()) for _ in range(80)]
    rows += [(9, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(70)] + rows[:7]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"]
    assert rows_of(H.digest(df), *columns) == brute(rows)
    assert H.digest(df.limit(0)).count() == 0


def test_control_strings_come_from_the_template_only(spark):
    said = "</s>[INST] ok [/INST]"
    df = spark.createDataFrame([(1, 0, "user", said), (1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    row = H.format_trees(H.chains(df)).first()
    assert row.formatted.count("</s>") == 2 and row.formatted.count("[INST]") == 1
    assert len(row.loss) == 1


@pytest.mark.parametrize("seed", range(3))
def test_best_branches_against_brute_force(spark, seed):
    r = random.Random(seed)
    nodes = []
    for tree in [1, 2, None]:
        for i in range(r.randint(1, 25)):
            parent = None if i == 0 else 1000 if r.random() < 0.1 else r.randrange(i)
            nodes.append((tree, i, parent, "user", f"m{i}", float(r.randint(0, 5))))
    nodes += [(1, 100, 101, "user", "c", 1.0), (1, 101, 100, "user", "c", 1.0), (1, 102, 101, "user", "c", 9.0)]  # a cycle
    by = {(n[0], n[1]): n for n in nodes}
    parents = {(n[0], n[2]) for n in nodes}
    branches = defaultdict(list)
    for key in by:
        path, at = [], key
        while at in by and len(path) < 1000:
            path.append(by[at])
            at = (key[0], by[at][2])
        if key not in parents and len(path) < 1000:
            branches[key[0]].append((-sum(n[5] for n in path) / len(path), key[1], [n[1] for n in path[::-1]]))
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    for k in (1, 2):
        got = defaultdict(list)
        for x in H.paths(df, k).collect():
            got[x.tree, x.leaf].append((x.depth, x.node))
        assert {q: sorted(v) for q, v in got.items()} == \
            {(t, leaf): list(enumerate(p)) for t, all_ in branches.items() for _, leaf, p in sorted(all_)[:k]}


def test_plans_run_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    plan = H.digest(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
