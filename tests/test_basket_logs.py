"""Basket logs of random changes against a replay, one event after another."""

import random

import pytest

from shopweave.operators import baskets as B


def replay(log):
    """Lines and closing of one basket."""
    lines, closed = {}, None
    for seq, op, variant, quantity, mark in log:
        if op == "add" and quantity > 0:
            lines[variant] = (lines[variant][0] + min(99, quantity), lines[variant][1]) if variant in lines else (min(99, quantity), seq)
        elif op == "remove" or op == "set" and quantity <= 0:
            lines.pop(variant, None)
        elif op == "set" and variant in lines:
            lines[variant] = (min(99, quantity), lines[variant][1])
        elif op == "clear":
            lines = {}
        elif op == "checkout" and mark and lines:
            closed = seq
            break
    return lines, closed


@pytest.mark.parametrize("stretch", [4096, 7])
def test_logs_equal_a_replay(spark, monkeypatch, stretch):
    monkeypatch.setattr(B, "STRETCH", stretch)
    rng = random.Random(stretch)
    logs = {}
    for basket in range(60):
        weights = [rng.choice([1, 6]), 2, 2, rng.choice([0, 1, 3]), rng.choice([0, 1])]
        ops = rng.choices(["add", "set", "remove", "clear", "checkout"], weights, k=rng.choice([3, 40, 120]))
        logs[str(basket)] = [(seq, op, rng.choice("abc") if op in ("add", "set", "remove") else None, rng.randint(-1, 120), rng.random() < 0.3) for seq, op in enumerate(ops)]
    rows = [(b, *e) for b, log in logs.items() for e in log]
    events = spark.createDataFrame(rows, "basket_id string, seq long, op string, variant_id string, quantity long, mark boolean")
    want, ends = {}, {}
    for b, log in logs.items():
        lines, closed = replay(log)
        ends |= {b: closed} if closed is not None else {}
        want |= {(b, v): line for v, line in lines.items()}
    assert 10 < len(ends) < 60
    assert {r.basket_id: r.closed_seq for r in B.closings(events).collect()} == ends
    assert {(r.basket_id, r.variant_id): (r.quantity, r.added_seq) for r in B.fold_baskets(events).collect()} == want
    assert B.fold_baskets(events.limit(0)).count() == 0
