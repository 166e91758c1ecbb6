"""Purchases kept as sums: any slicing gives the summary of all lines, and old lines are not read again."""

import random
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from frames import DAY, address, customer, days_ago, line, sources
from patronage.operators.purchase_state import merged, purchase_state, summary_from_state
from patronage.operators.transactions import transaction_summary
from patronage.params import INCREMENTAL, RunParams
from patronage.plans import layers
from patronage.plans.run import run

P = RunParams(data_date=DAY)
NEXT = date.fromordinal(DAY.toordinal() + 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def random_tables(spark, seed):
    draw = random.Random(seed)
    orders = [(n, draw.randint(1, 6), days_ago(draw.randint(0, 300)), draw.choice(["Completed", "Completed", "Open", None])) for n in range(40)]
    orders += [(100, None, days_ago(3), "Completed"), (101, 3, None, "Completed")]
    lines = [
        line(draw.choice(orders)[0], draw.choice([1, 2, 3, 4, 99, None]), draw.choice(["1", "2", "7"]), draw.choice(["1.50", "3", "2.25"]), draw.choice(["0", "0.25"]))
        for _ in range(120)
    ]
    lines += [(100, 1, None, None, None, None), (5, 2, None, None, None, None)]
    products = [(1, "A", "x"), (2, "B", "x"), (3, "A", "y"), (4, None, None)]
    returns = [(n, draw.randint(1, 6)) for n in range(9)] + [(3, 2), (None, 1)]
    return sources(spark, [customer(n) for n in range(1, 7)], [], [], orders, lines, products, returns)


def slices(tables, parts):
    by_order = lambda df, k: df.where(F.pmod(F.xxhash64("OrderID"), F.lit(parts)) == k)
    for k in range(parts):
        returns = tables["Returns"].where(F.pmod(F.xxhash64("ReturnID"), F.lit(parts)) == k)
        yield by_order(tables["Orders"], k), by_order(tables["OrderDetails"], k), returns


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 2), (3, 5)])
def test_any_slicing_gives_the_summary_of_all_lines(spark, seed, parts):
    tables = random_tables(spark, seed)
    members = tables["Customers"].select("CustomerID")
    want = rows(transaction_summary(members, tables["Orders"], tables["OrderDetails"], tables["Products"], tables["Returns"], P))
    states = [purchase_state(*s) for s in slices(tables, parts)]
    assert rows(summary_from_state(merged(*states), members, tables["Products"], P)) == want
    backwards = merged(*[merged(s) for s in reversed(states)], states[0].where("false"))
    assert rows(summary_from_state(backwards, members, tables["Products"], P)) == want
    unmerged = states[0]
    for s in states[1:]:
        unmerged = unmerged.unionByName(s)
    assert rows(summary_from_state(unmerged, members, tables["Products"], P)) == want
    renamed = tables["Products"].withColumn("Category", F.concat(F.lit("new "), "Category"))
    assert rows(summary_from_state(unmerged, members, renamed, P)) == rows(
        transaction_summary(members, tables["Orders"], tables["OrderDetails"], renamed, tables["Returns"], P)
    )


def deliveries(spark):
    """What a full run finds, and what is new on the next day; customer 2 bought on both days."""
    people = [customer(n, changed=days_ago(400)) for n in (1, 2, 3)]
    later = [customer(1), customer(2, changed=NEXT), customer(3, changed=NEXT)]
    homes = [address(n) for n in (1, 2, 3)]
    goods = [(1, "A", "x"), (2, "B", "y")]
    old = [(10, 1, days_ago(9), "Completed"), (11, 2, days_ago(5), "Completed")], [line(10, 1, "1", "8"), line(11, 1, "2", "5"), line(11, 2, "1", "3")], [(11, 2)]
    new = [(20, 2, NEXT, "Completed"), (21, 3, NEXT, "Completed")], [line(20, 2, "9", "4"), line(21, 1, "1", "1")], [(20, 2)]
    first = sources(spark, people, homes, [], old[0], old[1], goods, old[2])
    second = sources(spark, later, homes, [], new[0], new[1], goods, new[2])
    everything = sources(spark, later, homes, [], old[0] + new[0], old[1] + new[1], goods, old[2] + new[2])
    return first, second, everything


def analytics(store, day):
    return rows(store.read_partition("gold", "CustomerAnalytics", {"ProcessDate": day}).drop("_gold_process_date", "_gold_process_timestamp"))


def test_incremental_run_on_new_orders_equals_one_on_all(spark, store, tmp_path):
    first, second, everything = deliveries(spark)
    kept = replace(P, keep_state=True)
    changed = replace(kept, data_date=NEXT, process_type=INCREMENTAL)
    run(store, layers.Frames(first), kept)
    run(store, layers.Frames(second), changed)
    once = rows(store.read("silver", "TransactionSummary").where(F.col("_silver_process_date") == F.lit(NEXT)).drop("_silver_process_timestamp"))
    assert [r[0] for r in once] == [2, 3] and once[0][1] == 2  # two orders of customer 2, of which one is new
    again = type(store)(spark, str(tmp_path / "again"))
    run(again, layers.Frames(everything), replace(P, data_date=NEXT, process_type=INCREMENTAL))
    assert analytics(store, NEXT) == analytics(again, NEXT)
    run(store, layers.Frames(second), changed)  # a repeated slice replaces itself
    assert analytics(store, NEXT) == analytics(again, NEXT)
    layers.PurchaseStates(store).compact(NEXT)
    with pytest.raises(ValueError, match="part of the full state already"):
        run(store, layers.Frames(second), changed)


def test_slices_in_the_full_state_count_once(spark, store):
    first, second, everything = deliveries(spark)
    of = lambda t: purchase_state(t["Orders"], t["OrderDetails"], t["Returns"])
    states, incremental = layers.PurchaseStates(store), replace(P, process_type=INCREMENTAL)
    with pytest.raises(FileNotFoundError, match="full run"):
        states.read()
    states.compact(NEXT)
    states.put(of(first), P)
    states.put(of(second), replace(incremental, data_date=NEXT))
    want = rows(merged(of(everything)))
    assert rows(merged(states.read())) == want
    store.drop_before = lambda *a: []  # the clean-up after the commit is lost
    states.compact(NEXT)
    del store.drop_before
    assert states.through() == NEXT and rows(states.read()) == want
    states.compact(NEXT)
    assert rows(states.read()) == want
    states.put(of(first), replace(P, data_date=NEXT))  # a full run starts anew
    assert rows(states.read()) == rows(merged(of(first)))


def test_new_state_and_summary_read_no_old_line(spark, store):
    first, second, _ = deliveries(spark)
    for frames, p in ((first, P), (second, replace(P, data_date=NEXT, process_type=INCREMENTAL))):
        bronze = [layers.ingest_bronze(store, layers.Frames(frames), name, p)[1] for name in ("Orders", "OrderDetails", "Returns")]
        state = purchase_state(*bronze)
        assert {f"_ingestion_date={p.data_date}" in f for f in state.inputFiles()} == {True}
        layers.PurchaseStates(store).put(state, p)
    summary = summary_from_state(layers.PurchaseStates(store).read(), first["Customers"], first["Products"], P)
    assert summary.inputFiles() and not [f for f in summary.inputFiles() if "/bronze/" in f]


def test_old_slices_join_the_full_state_by_themselves(spark, store):
    first, second, _ = deliveries(spark)
    of = lambda t: purchase_state(t["Orders"], t["OrderDetails"], t["Returns"])
    states, incremental = layers.PurchaseStates(store), replace(P, process_type=INCREMENTAL, state_days=2)
    day = lambda k: date.fromordinal(DAY.toordinal() + k)
    states.put(of(first), P)
    state = of(second).persist()
    for k in range(1, 4):
        states.put(state, replace(incremental, data_date=day(k)))
    assert states.days() == [day(k) for k in (1, 2, 3)] and states.through() == DAY
    states.put(state, replace(incremental, data_date=day(4)))
    assert states.days() == [day(3), day(4)] and states.through() == day(2)
    assert rows(merged(states.read())) == rows(merged(of(first), *[state] * 4))
    state.unpersist()
