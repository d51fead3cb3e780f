"""Apply of changes against a target, change by change, against plain loops."""

import random

import pytest

from rivulet.operators.delivery import applied_batch


def plain(there, changes, repair, missing_fails):
    there, out = set(there), {}
    for i, key, op in changes:
        known = key in there
        if op == "insert":
            verdict = (("applied", "repaired_as_update") if repair else ("failed", "duplicate_key")) if known else ("applied", None)
            there.add(key)
        elif known:
            verdict = ("applied", None)
        elif repair:
            verdict = ("applied", "repaired_as_insert" if op == "update" else "nothing_to_delete")
            there |= {key} if op == "update" else set()
        else:
            verdict = ("failed", "no_row") if missing_fails else ("applied", "nothing_there")
        if op == "delete":
            there.discard(key)
        out[i] = verdict
    return out


def run(spark, there, changes, **how):
    target = spark.createDataFrame([(k,) for k in there], "pk long")
    inbox = spark.createDataFrame(changes, "id long, pk long, op string")
    return {r.id: (r.status, r.last_error) for r in applied_batch(target, inbox, "pk", **how).collect()}


def test_a_failed_update_makes_no_row(spark):
    changes = [(1, 7, "update"), (2, 7, "insert"), (3, 7, "update")]
    assert run(spark, [], changes, missing_fails=True) == {1: ("failed", "no_row"), 2: ("applied", None), 3: ("applied", None)}
    assert run(spark, [], changes) == {1: ("applied", "nothing_there"), 2: ("applied", None), 3: ("applied", None)}


@pytest.mark.parametrize("how", [{}, {"missing_fails": True}, {"repair": True}])
def test_against_a_plain_loop(spark, how):
    rng = random.Random(8)
    changes = [(i, rng.choice([1, 1, 1, 2, 3, 4]), rng.choice(["insert", "update", "delete"])) for i in rng.sample(range(10_000), 400)]
    want = plain([1, 4, 9], sorted(changes), how.get("repair", False), how.get("missing_fails", False))
    assert run(spark, [1, 4, 9], changes, **how) == want
