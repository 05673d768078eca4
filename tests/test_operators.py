"""Cases of the ledger operators that the tables do not hold."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark import config, model
from tidemark.functions import columns as C
from tidemark.functions import hashing as H
from tidemark.operators import effects as E
from tidemark.operators import growth, lifecycle, reconcile, text, views
from tidemark.operators import materialize as M

RUN = ("default", "w", "r")
NODE = "namespace string, workflow_id string, run_id string, seq int"


# --- state ----------------------------------------------------------------------------------------------------------

STATE = (
    "namespace string, workflow_id string, run_id string, run_rank int, seq int, step int, path string, kind string, status string, output_json string, "
    "input_snapshot string, input_hash string, sealed boolean, final_state_hash string, node_count int"
)
SHIPPED = {"log": ["12 kg", "label 7", "photo", "gone"], "cost": 11, "place": "van"}
REDUCERS = {"log": "append", "cost": "sum", "place": "last"}


def parcel(lost=(), backwards=False, overcharged=False, sealed=True):
    """A parcel is weighed, then labelled, photographed and insured at once, then shipped."""
    work = [
        ("weigh", 1, {"log": ["12 kg"], "cost": 2}), ("label", 2, {"log": ["label 7"]}), ("photo", 2, {"log": ["photo"], "cost": 1}), ("safe", 2, {"cost": 90 if overcharged else 7}),
        ("ship", 3, {"log": ["gone"], "place": "van"}),
    ]
    told = [("UPDATE", "COMMITTED"), json.dumps({"log": [], "cost": 1, "place": "shelf"}), None, sealed, M.canonical_hash(SHIPPED), 6]
    rows = [(*RUN, 1, 0, 0, "start", *told[0], json.dumps({"result": {}}), *told[1:])]
    for number, (name, step, delta) in enumerate(work, 1):
        if name not in lost:
            output = json.dumps({"result": delta, "langgraph_command": None, "langgraph_interrupts": None})
            rows.append((*RUN, 1, 10 - number if backwards else number, step, name, *told[0], output, None, *told[2:]))
    return rows


@pytest.mark.parametrize(
    "case, label, reason",
    [
        ({}, "EXACT", None),
        ({"backwards": True}, "EXACT", None),
        ({"lost": ("label", "photo", "safe")}, "GAP", "the state's hash is not the sealed one; 3 rows are missing"),
        ({"lost": ("photo", "safe")}, "GAP", "the state's hash is not the sealed one; 2 rows are missing"),
        ({"overcharged": True}, "GAP", "the state's hash is not the sealed one"),
        ({"sealed": False}, "OPEN", None),
    ],
)
def test_parcel(spark, case, label, reason):
    row = M.fold(spark.createDataFrame(parcel(**case), STATE), REDUCERS).first()
    assert (row.label, row.reason) == (label, reason)
    if label != "GAP":
        assert json.loads(row.state) == SHIPPED and row.rows_used == 6


def test_input_hash_names_positions(spark):
    rows = [list(r) for r in parcel(overcharged=True)]
    rows[5][11] = M.canonical_hash({"log": ["12 kg", "label 7", "photo"], "cost": 11, "place": "shelf"})
    row = M.fold(spark.createDataFrame([tuple(r) for r in rows], STATE), REDUCERS).first()
    assert row.positions == ["step 3: input of ship (ship) differs"]


def test_nodes_are_held_against_what_they_read(spark):
    """The van reads the place, the label reads log and cost: a wrong cost concerns the label only, and all gaps show."""
    rows = [list(r) for r in parcel(overcharged=True)]
    rows[2][11], rows[5][11] = M.canonical_hash({"log": ["12 kg"], "cost": 4}), M.canonical_hash({"place": "shelf"})
    rows[5][5] = 7
    frame = spark.createDataFrame([(*r, r[6]) for r in rows], STATE + ", node string")
    row = M.fold(frame, REDUCERS, inputs={"label": ["cost", "log", "no such channel"], "ship": ["place"]}).first()
    assert row.positions == ["step 2: input of label (label) differs", "no rows in steps 3 to 6"]
    assert M.fold(frame, REDUCERS).first().positions == ["step 2: input of label (label) differs", "step 7: input of ship (ship) differs", "no rows in steps 3 to 6"]


def test_lost_write_without_position(spark):
    row = M.fold(spark.createDataFrame(parcel(overcharged=True), STATE), REDUCERS).first()
    assert row.positions == ["a write is lost after step 3"]
    unsealed_hash = [(*r[:13], None, r[14]) for r in parcel()]
    assert M.fold(spark.createDataFrame(unsealed_hash, STATE), REDUCERS).first().reason == "the seal has no final hash"


def test_payload_converter(spark):
    import base64

    rows = [(*r[:9], base64.b64encode(r[9].encode()).decode(), *r[10:]) for r in parcel()]
    row = M.fold(spark.createDataFrame(rows, STATE), REDUCERS, convert=lambda t: base64.b64decode(t).decode()).first()
    assert row.label == "EXACT"


def test_hashes_of_a_state_follow_its_writes():
    state = M.State({"a": [1], "b": "x"})
    assert state.hash(("a", "b", "c")) == M.canonical_hash({"a": [1], "b": "x"})
    state.write("c", {"é": 1})
    assert state.hash(("c", "b")) == M.canonical_hash({"b": "x", "c": {"é": 1}}) and state.hash(("a", "b", "c")) == M.canonical_hash(state.values)
    state.write("a", [1, 2])
    assert state.hash(("a",)) == M.canonical_hash({"a": [1, 2]})


def test_chain_takes_the_later_run(spark):
    later = [list(r) for r in parcel(overcharged=True)[4:5]]
    later[0][2], later[0][3] = "r2", 2
    rows = parcel() + [tuple(r) for r in later]
    row = M.fold(spark.createDataFrame(rows, STATE), REDUCERS, chain=True, unhashed=True).first()
    assert json.loads(row.state) == {**SHIPPED, "cost": 94} and (row.rows_used, row.chain_rows_used) == (1, 5)
    assert json.loads(M.fold(spark.createDataFrame(rows, STATE), REDUCERS, chain=True).first().state)["log"] == []  # no hashes, no fill


def test_what_is_folded(spark):
    rows = [list(r) for r in parcel()]
    rows[1][7], rows[2][8], rows[3][9] = "INTERRUPT", "PROVISIONAL", json.dumps({"result": {"log": ["photo"], "cost": 1, "colour": "red"}})
    frame = spark.createDataFrame([(*r, "post" if i < 5 else "van") for i, r in enumerate(rows)], STATE + ", graph string")
    state = lambda **more: json.loads(M.fold(frame, REDUCERS, **more).first().state)
    assert state() == {"log": ["photo", "gone"], "cost": 9, "place": "van"}
    assert state(include_provisional=True)["log"] == ["label 7", "photo", "gone"]
    assert state(graph="post")["place"] == "shelf"


def test_reducers():
    assert M.merge_by_id([{"id": 1, "t": "a"}], [[{"id": 2, "t": "b"}], {"id": 1, "t": "c"}]) == [{"id": 1, "t": "c"}, {"id": 2, "t": "b"}]
    assert M.add_up(None, [1, 2]) == 3 and M.append(None, [[1], [2]]) == [1, 2] and M.last(0, [1, 2]) == 2


def test_deltas():
    assert M.delta_of("COMMAND", '{"langgraph_command":{"update":{"a":1}}}') == [("a", 1)]
    assert M.delta_of("UPDATE", '{"result":[["a",1],["a",2]]}') == [("a", 1), ("a", 2)]
    assert M.delta_of("INTERRUPT", '{"result":{"a":1}}') == [] and M.delta_of("UPDATE", None) == []


# --- repair ---------------------------------------------------------------------------------------------------------

HIST = f"{NODE}, scheduled_event_id long, status string, cancel_requested boolean, accepted boolean, result_hash string, attempt int"
ROWS = f"{NODE}, status string, output_hash string, attempt int"
STATES = "namespace string, workflow_id string, run_id string, found boolean, closed boolean, sealed boolean, degraded boolean"


def clean(n=30):
    hist = [(*RUN, i, i, "COMPLETED", False, True, f"h{i}", 1) for i in range(n)]
    return hist, [(*RUN, i, "COMMITTED", f"h{i}", 1) for i in range(n)]


def counters(spark, hist, rows):
    sealed = spark.createDataFrame([RUN], "namespace string, workflow_id string, run_id string")
    row = reconcile.invariants(spark.createDataFrame(hist, HIST), spark.createDataFrame(rows, ROWS), sealed).first().asDict()
    return {k: v for k, v in row.items() if k.endswith("_rows") or k == "wrongly_committed" if v}


def test_clean_run_has_no_counters(spark):
    assert counters(spark, *clean()) == {}


def test_each_corruption_trips_one_counter(spark):
    hist, rows = clean()
    assert counters(spark, hist, [*rows, (*RUN, 1000, *rows[3][4:])]) == {"duplicate_rows": 1}
    assert counters(spark, hist, [(*r[:5], "tampered", 1) if r[3] == 5 else r for r in rows]) == {"divergent_rows": 1}
    assert counters(spark, hist, [r for r in rows if r[3] != 7]) == {"lost_rows": 1}
    assert counters(spark, hist, [(*r[:4], "PROVISIONAL", *r[5:]) if r[3] == 9 else r for r in rows]) == {"orphan_rows": 1}
    assert counters(spark, [(*h[:5], "FAILED", False, False, *h[8:]) if h[3] == 4 else h for h in hist], rows) == {"wrongly_committed": 1}


def decided(spark, hist, rows, state):
    frames = (spark.createDataFrame(hist, HIST), spark.createDataFrame(rows, ROWS), spark.createDataFrame([(*RUN, *state)], STATES))
    actions = reconcile.decide(*frames)
    again = reconcile.decide(frames[0], reconcile.apply_actions(frames[0], frames[1], actions), frames[2])
    first = {(r.seq, r.action) for r in actions.collect() if r.action != "none"}
    return first, {(r.seq, r.action) for r in again.collect() if r.action != "none"}


def test_reconcile_cases(spark):
    hist = [(*RUN, i, i, "COMPLETED", False, True, f"h{i}", 1) for i in range(2)]
    late = [hist[0], (*RUN, 1, 1, "COMPLETED", True, False, "h1", 1)]
    rows = [(*RUN, 0, "COMMITTED", "h0", 1), (*RUN, 1, "PROVISIONAL", "h1", 1)]
    ended = (True, True, False, False)
    assert decided(spark, hist, rows, ended) == ({(1, "commit")}, set())
    assert decided(spark, hist, rows, (True, True, True, False))[0] == {(None, "skipped-sealed")}
    assert decided(spark, late, rows, ended) == ({(1, "abandon")}, set())
    assert decided(spark, hist, [(*RUN, 1, "PROVISIONAL", "bad", 1)], ended) == ({(0, "insert"), (1, "rewrite")}, set())
    assert decided(spark, hist, rows, (False, True, False, False))[0] == {(None, "history-gone")}
    assert decided(spark, hist, rows, (True, False, False, False))[0] == {(None, "open")}


# --- life cycle -----------------------------------------------------------------------------------------------------


def test_seal(spark):
    requests = spark.createDataFrame(
        [("n", "w", "whole", "COMPLETED", 2, 1), ("n", "w", "short", "FAILED", 4, 2), ("n", "w", "open", "RUNNING", 1, 0), ("n", "w", "none", "COMPLETED", 0, 0)],
        "namespace string, workflow_id string, run_id string, status string, node_count int, accepted_count int",
    )
    nodes = spark.createDataFrame(
        [("n", "w", "whole", 0, "COMMITTED"), ("n", "w", "whole", 1, "PROVISIONAL"), ("n", "w", "short", 0, "COMMITTED"), ("n", "w", "short", 2, "PROVISIONAL")], f"{NODE}, status string"
    )
    seals = lifecycle.seal(requests, nodes)
    got = {r.run_id: (r.committed_count, r.abandoned_count, r.degraded, r.missing_seqs, r.refused) for r in seals.collect()}
    assert got["whole"] == (1, 1, False, None, False)
    assert got["short"] == (1, 0, True, [1, 3], False)
    assert got["open"][4] is True
    assert got["none"] == (0, 0, False, None, False)
    assert {(r.run_id, r.seq): r.status for r in lifecycle.settle(nodes, seals).collect()}["whole", 1] == "ABANDONED"


def test_observe(spark):
    events = spark.createDataFrame(
        [(*RUN, 1, 0, "ok", None), (*RUN, 2, 1, "failed", None), (*RUN, 3, 2, "ok", [0, 1])],
        "namespace string, workflow_id string, run_id string, step int, seq int, result string, carried array<int>",
    )
    rows = lifecycle.observe(events).orderBy("step").collect()
    assert [(r.accepted, r.commits, r.abandons) for r in rows] == [(1, [0], []), (1, [0], [1]), (2, [2], [])]


# --- effects --------------------------------------------------------------------------------------------------------


def run_effect(*events):
    effect = E.Effect()
    return [effect.apply(e, "other" if e.endswith("!") else "h", "r") if not e.endswith("!") else effect.apply(e[:-1], "other", "r") for e in events], effect


def test_effect_states():
    assert run_effect("call", "done", "call")[0] == ["called", "recorded", "replayed"]
    assert run_effect("call", "done", "call")[1].prevented == 1
    assert run_effect("call", "call!")[0] == ["called", "divergence"]
    assert run_effect("call", "done", "call!")[0][-1] == "divergence"
    assert run_effect("call", "crash", "call")[1].status == "UNKNOWN"
    assert run_effect("call", "not-sent", "call")[0] == ["called", "released", "called"]
    outcomes, effect = run_effect("call", "crash", "reconcile-found")
    assert (outcomes[-1], effect.status, effect.resolution) == ("found", "DONE", "reconciled:done")
    assert run_effect("call", "crash", "reconcile-not-done")[1].resolution == "reconciled:not-done"
    assert run_effect("call", "resolve-not-done", "call")[0] == ["called", "resolved", "called"]
    outcomes, effect = run_effect("call", "done", "resolve-not-done")
    assert (outcomes[-1], effect.status) == ("ignored", "DONE")


def test_prices(spark):
    prices = spark.createDataFrame([("gpt-4o", 2.5, 10.0), ("gpt-4o-mini", 0.15, 0.6)], "prefix string, price_in double, price_out double")
    prices = prices.selectExpr("prefix", "cast(price_in as decimal(10,4)) price_in", "cast(price_out as decimal(10,4)) price_out")
    calls = spark.createDataFrame([("gpt-4o", 1000000, 0), ("gpt-4o-mini-x", 1000000, 1000000), ("local", 5, 5)], "model string, tokens_in long, tokens_out long")
    used = {r.model: (None if r.cost_usd is None else float(r.cost_usd), r.tokens_in) for r in E.usage(E.priced(calls, prices), ["model"]).collect()}
    assert used == {"gpt-4o": (2.5, 1000000), "gpt-4o-mini-x": (0.75, 1000000), "local": (None, 5)}


# --- functions ------------------------------------------------------------------------------------------------------


def test_canonical_form(spark):
    assert H.canonical('{"b": 1.0, "a": [1, null, "é"]}') == '{"a":[1,null,"é"],"b":1.0}'
    rows = spark.createDataFrame([('{"b":1,"a":2}',), ('{"a":2,"b":1}',), (None,)], "j string")
    got = [r[0] for r in rows.select(H.content_hash("j")).collect()]
    assert got[0] == got[1] and got[2] is None
    assert got[0] == rows.select(H.flat_hash(F.col("j"))).first()[0]


def test_keys_with_nulls_are_null(spark):
    row = spark.createDataFrame([("a", None)], "x string, y string").select(H.key_of(F.col("x"), F.col("y"))).first()
    assert row[0] is None


def test_message_hash_ignores_ids(spark):
    rows = spark.createDataFrame([('[{"id":1,"text":"a"}]',), ('[{"id":2,"replayed":true,"text":"a"}]',)], "m string")
    a, b = (r[0] for r in rows.select(H.message_hash("m")).collect())
    assert a == b


@pytest.mark.parametrize("n", [1, 2, 7, 30, 59])
def test_nearest_rank_is_half_even(spark, n):
    values = [float((i * 37) % 101) for i in range(n)]
    row = growth.percentiles(spark.createDataFrame([("g", v) for v in values], "g string, v double"), ["g"], "v").first()
    for p in (50, 95):
        assert row[f"p{p}"] == round(sorted(values)[round(p / 100 * (n - 1))], 3)


def test_duration_rounds_half_up(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(t, t + dt.timedelta(microseconds=1234500)), (t, None)], "a timestamp, b timestamp")
    assert [r[0] for r in rows.select(C.duration_ms(F.col("a"), F.col("b"))).collect()] == [1235, None]


def test_retry_waste_and_attempt_waste_differ(spark):
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame(
        [(*RUN, 0, t, 1, "WROTE", 1, 1, None), (*RUN, 0, t + dt.timedelta(1), 1, "WROTE", 2, 2, None)],
        f"{NODE}, fence_scheduled_at timestamp, attempt int, outcome string, tokens_in int, tokens_out int, cost_usd decimal(14,6)",
    )
    nodes = spark.createDataFrame([(*RUN, 0, t + dt.timedelta(1), 1, "n", "COMMITTED")], f"{NODE}, fence_scheduled_at timestamp, attempt int, node string, status string")
    waste = views.retry_waste(log, nodes).first()
    assert (waste.wasted_attempts, waste.wasted_tokens, waste.wasted_cost_usd) == (1, 2, None)
    assert views.attempt_waste(log, nodes).first().retry_waste == 0


def test_violations(spark):
    rows = spark.createDataFrame([(*RUN, 0, "COMMITTED"), (*RUN, 0, "LOST"), ("default", "w", None, 1, "COMMITTED")], f"{NODE}, status string")
    got = {(r.rule, r.column): r.rows for r in model.violations(rows, "nodes").collect()}
    assert got == {("unique", "namespace,workflow_id,run_id,seq"): 2, ("check", "status"): 1, ("not null", "run_id"): 1}


def test_init_views(spark):
    assert "ledger_nodes" in model.init_views(spark)
    assert spark.table("ledger_meta").first().value == model.SCHEMA_VERSION


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"chunk_min": 10, "chunk_avg": 20, "chunk_max": 40}')
    assert config.load(str(path), {"TIDEMARK_CHUNK_MAX": "80"}).chunk_max == 80
    with pytest.raises(ValueError):
        config.load(None, {"TIDEMARK_SCHEMA_VERSION": "2"})
    assert config.check_retention(1, 3) and config.check_retention(3, 3) is None


def test_text_checks(spark):
    docs = spark.createDataFrame([(1, "It costs 1,234.5 now. Always exact.\nAlmost always exact (when sealed).")], "k int, t string")
    assert {r.number for r in text.numbers(docs, "k", "t").collect()} == {1234.5}
    assert [r.sentence for r in text.bare_claims(docs, "k", "t", ["exact"], ["when"]).collect()] == ["Always exact."]
    fault, selectors = text.parse_fault(F.lit("F3:wf=a:seq=2"))
    row = spark.range(1).select(fault.alias("f"), text.fault_matches(selectors, {"wf": F.lit("a"), "seq": F.lit(2), "run": F.lit("x")}).alias("hit")).first()
    assert (row.f, row.hit) == ("F3", True)


def test_clock_inversion(spark):
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(*RUN, 0, 1, t + dt.timedelta(minutes=5)), (*RUN, 0, 2, t)], f"{NODE}, attempt int, worker_time timestamp")
    assert growth.clock_inversions(log, log.where("attempt = 2")).first().inverted
