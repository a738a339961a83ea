"""The numeric vectors every operator has to meet, and the behaviours that are easy to get wrong."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigilframe.functions import exprs
from vigilframe.operators import cache, gate, lifecycle, pool, sampling, select, wire, zeroshot


def preds(spark, scores, item=1):
    return spark.createDataFrame([(item, i, i + 1, float(s)) for i, s in enumerate(scores)], "item long, ordinal int, label long, score float")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def labels(df):
    return [r["label"] for r in df.orderBy("rank").collect()]


def test_select_keeps_five_or_confident(spark):
    assert labels(select.select_top(preds(spark, [0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2]), ["item"])) == [1, 2, 3, 4, 5]
    assert labels(select.select_top(preds(spark, [0.95, 0.94, 0.93, 0.92, 0.91, 0.905]), ["item"])) == [1, 2, 3, 4, 5, 6]
    # exactly 0.90 as FLOAT is not above it
    assert labels(select.select_top(preds(spark, [0.95, 0.94, 0.93, 0.92, 0.91, 0.90]), ["item"])) == [1, 2, 3, 4, 5]
    assert labels(select.select_top(preds(spark, [0.5] * 7), ["item"])) == [1, 2, 3, 4, 5]
    assert labels(select.select_top(preds(spark, []), ["item"])) == []


def test_nan_sorts_last(spark):
    assert labels(select.select_top(preds(spark, [math.nan, 0.1, 0.2]), ["item"])) == [3, 2, 1]


def test_flat_threshold_is_inclusive_and_capped(spark):
    assert labels(select.flat_top(preds(spark, [0.5, 0.85, 0.4, 0.6]), ["item"], 0.5, 2)) == [2, 4]
    assert labels(select.flat_top(preds(spark, [0.85, 0.9]), ["item"], 0.9)) == [2]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from([0.1, 0.3, 0.5, 0.9, 0.91, 0.95, 1.0]), max_size=9))
def test_select_against_brute_force(spark, scores):
    import numpy as np

    order = sorted(range(len(scores)), key=lambda i: (-np.float32(scores[i]), i))
    want = [i + 1 for n, i in enumerate(order) if n < 5 or np.float32(scores[i]) > np.float32(0.9)]
    assert labels(select.select_top(preds(spark, scores), ["item"])) == want


def plan(spark, duration, fps, *steps):
    d, f = F.lit(float(duration)), F.lit(float(fps))
    arrays = [sampling.uniform(d, F.lit(n)) if m == "uniform" else sampling.at_rate(d, F.lit(float(n))) for m, n in steps]
    return one(spark, sampling.merge_steps(F.array(*arrays), d, f).alias("t"))["t"]


def test_frame_plans(spark):
    assert plan(spark, 9, 30, ("uniform", 3), ("uniform", 3)) == pytest.approx([1.5, 4.5, 7.5])
    assert plan(spark, 8, 30, ("uniform", 2), ("fps", 1)) == pytest.approx([2, 6, 0, 1, 3, 4, 5, 7])
    many = plan(spark, 60, 30, ("uniform", 2000))
    assert many and max(many) <= 60 - 1 / 30 + 1e-9
    assert len(one(spark, sampling.at_rate(F.lit(1.0), F.lit(10.0)).alias("t"))["t"]) == 11  # rounding adds up
    assert plan(spark, 0, 30, ("uniform", 3)) == [] and plan(spark, 5, 30, ("uniform", 0)) == []
    assert one(spark, sampling.last_seek(F.lit(10.0), F.lit(0.0)).alias("t"))["t"] == pytest.approx(9.95)


def test_every_nth_and_missing_parameters(spark):
    assert one(spark, sampling.every_nth(F.lit(1.0), F.lit(10.0), F.lit(4)).alias("t"))["t"] == pytest.approx([0, 0.4, 0.8])
    assert one(spark, sampling.every_nth(F.lit(1.0), F.lit(10.0), F.lit(0)).alias("t"))["t"] == []
    none = F.lit(None)
    with pytest.raises(Exception, match="needs count"):
        one(spark, sampling.step_times(F.lit("uniform"), F.lit(1.0), F.lit(1.0), none.cast("int"), none.cast("double"), none.cast("int"), none.cast("array<double>")))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 40).map(lambda x: x / 40), max_size=15))
def test_dedupe_against_a_loop(spark, times):
    kept = []
    for t in times:
        if not any(abs(c - t) <= 0.05 for c in kept):
            kept.append(t)
    assert one(spark, sampling.dedupe(F.array(*map(F.lit, times)).cast("array<double>")).alias("t"))["t"] == kept


def frames(spark, rows):
    return spark.createDataFrame(rows, "item long, frame_index int, label long, score float")


def test_pooling(spark):
    f = frames(spark, [(1, 0, 1, 0.9), (1, 0, 2, 0.1), (1, 1, 1, 0.5)])
    mean = {r["label"]: r["score"] for r in pool.pool(f, ["item"], "mean").collect()}
    assert mean == pytest.approx({1: 0.7, 2: 0.05}, abs=1e-6)
    assert {r["label"]: r["score"] for r in pool.pool(f, ["item"], "max").collect()}[1] == pytest.approx(0.9)
    with pytest.raises(ValueError):
        pool.pool_scores(f, ["item"], "median")


def test_trigger(spark):
    p = F.array(F.struct(F.lit(1).alias("label"), F.lit(0.95).cast("float").alias("score")), F.struct(F.lit(2).alias("label"), F.lit(0.05).cast("float").alias("score")))
    assert list(one(spark, select.triggered(p, [1], 0.85), select.triggered(p, [1], 0.99), select.triggered(p, [3], 0.5), select.triggered(p, [], 0.0))) == [True, False, False, False]


def test_prefix_and_pending(spark):
    f = frames(spark, [(1, i, 1, s) for i, s in enumerate([0.1, 0.9, 0.2, 0.95])] + [(2, 0, 1, 0.1)])
    got = pool.until_trigger(f, ["item"], pool.fires([1], 0.9)).select("item", "frame_index").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (1, 1), (2, 0)]
    assert pool.pending(f, f.where("frame_index < 2"), ["item", "frame_index"]).count() == 2


def test_taxonomy_scores(spark):
    rows = [(1, 0, 1001, 1, "mean", 0.2), (1, 1, 1001, 1, "mean", 0.6), (1, 2, 1002, 1, None, 0.3), (1, 3, 1002, 1, None, 0.5)]
    df = spark.createDataFrame(rows, "item long, prompt_ix int, child_id long, parent_id long, agg string, score double")
    got = {r["child_id"]: r["score"] for r in zeroshot.taxonomy_scores(df, "item").collect()}
    assert got == pytest.approx({1001: 0.4, 1002: 0.5})  # a missing aggregation is the maximum


def test_zero_vector_has_no_direction(spark):
    assert one(spark, zeroshot.l2_normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("v"))["v"] == [None, None]
    assert one(spark, zeroshot.prompt_text(F.lit("cat"), "a {} or {}").alias("v"))["v"] == "a cat or cat"
    assert one(spark, zeroshot.prompt_text(F.lit("cat"), None).alias("v"))["v"] == "cat"


def test_gates(spark):
    s = spark.createDataFrame([(1, 1, False, "queued"), (1, 2, True, "queued"), (1, 3, False, "queued"), (1, 4, False, "done")], "item long, step int, fires boolean, state string")
    got = [r["state"] for r in gate.gate_states(s, ["item"], F.col("fires"), "step", F.col("state") == "done").orderBy("step").collect()]
    assert got == ["done", "done", "skipped", "done"]
    failed = gate.fail_from(s, ["item"], F.col("step") == 2).orderBy("step").collect()
    assert [r["state"] for r in failed] == ["queued", "failed", "failed", "done"]


def test_pipeline_replaces_models(spark):
    items = spark.createDataFrame([("a", ["x"], "p"), ("b", ["x"], None), ("c", ["x"], "lost")], "item string, models array<string>, pipeline string")
    pipes = spark.createDataFrame([("p", 2, "n"), ("p", 1, "m")], "pipeline string, order int, model string")
    got = {r["item"]: (r["models"], r["pipeline_error"]) for r in gate.resolve(items, pipes).collect()}
    assert got == {"a": (["m", "n"], None), "b": (["x"], None), "c": (None, "unknown pipeline: lost")}


def test_caches(spark):
    urls = spark.createDataFrame([("u", "m", "main", "h", 10), ("u", "n", "main", "h", 10)], "url_hash string, model string, revision string, content_hash string, created_at long")
    stored = spark.createDataFrame([("h", "m", "main", "out", 10)], "content_hash string, model string, revision string, output string, created_at long")
    items = spark.createDataFrame([(1, "u", "m", "main"), (2, "u", "m", "main"), (2, "u", "n", "main")], "item long, url_hash string, model string, revision string")
    assert [tuple(r) for r in cache.url_cache_hits(items, urls, stored).collect()] == [(1, "m", "out")]  # all or nothing
    assert cache.url_cache_hits(items, urls, stored, 11).count() == 0
    assert cache.fresh_after(100, 30) == 70 and cache.fresh_after(100, 0) == 0


def test_roll_up_never_fails_and_keeps_terminal(spark):
    tasks = spark.createDataFrame([("a", "processing"), ("b", "cancelled"), ("c", "processing"), ("d", "processing")], "task_id string, state string")
    items = spark.createDataFrame([("a", "failed"), ("a", "completed"), ("b", "queued"), ("c", "retrying")], "task_id string, state string")
    got = {r["task_id"]: r["state"] for r in lifecycle.roll_up(tasks, items).collect()}
    assert got == {"a": "completed", "b": "cancelled", "c": "processing", "d": "completed"}


def test_validation_order(spark):
    models = spark.createDataFrame([("on", True, None), ("off", False, None), ("scan", True, "s")], "model string, enabled boolean, strategy string")
    items = spark.createDataFrame(
        [(1, "image", False, ["off", "lost"]), (2, "video", False, ["scan", "on"]), (3, "text", False, ["on"]), (4, "image", False, []), (5, "bytes", True, ["scan"]), (6, "image", False, None)],
        "item long, kind string, video boolean, models array<string>",
    )
    got = {r["item"]: r["problem"] for r in lifecycle.validate_items(items, models, ["s"]).collect()}
    assert got == {1: "model is disabled: off", 2: "model has no known strategy: on", 3: "text input is not supported", 4: "no models requested", 5: None, 6: "no models requested"}


def test_retries_recovery_and_states(spark):
    assert list(one(spark, *[exprs.retry_backoff(F.lit(n)) for n in (1, 2, 5, 6, 64)])) == [1, 2, 16, 30, 30]
    tasks = spark.createDataFrame([("a", "processing", 3, 1), ("b", "queued", 0, 2), ("c", "completed", 0, 3)], "task_id string, state string, attempts long, created_at long")
    assert {r["task_id"]: (r["attempts"], r["action"]) for r in lifecycle.recover(tasks).collect()} == {"a": (4, "fail"), "b": (1, "requeue")}
    with pytest.raises(Exception, match="unknown state"):
        one(spark, exprs.checked_state(F.lit("odd"), exprs.TASK_STATES))
    assert list(one(spark, exprs.model_done(F.lit("failed")), exprs.model_done(F.lit("skipped")))) == [False, True]


def test_retention_is_strict(spark):
    tasks = spark.createDataFrame([("a", "completed", 10), ("b", "completed", 11), ("c", "processing", 1)], "task_id string, state string, updated_at long")
    kept, children = lifecycle.purge(tasks, {"items": tasks.select("task_id")}, 11)
    assert sorted(r["task_id"] for r in kept.collect()) == ["b", "c"] and children["items"].count() == 2


def test_units(spark):
    sizes = ["4gb", "512mb", "2g", "1024", "1.5gb", "0", "", "garbage"]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, s string").orderBy("i").select(exprs.size_bytes(F.col("s"))).collect()]
    assert got == [4 << 30, 512 << 20, 2 << 30, 1024, 3 << 29, None, None, None]
    durations = ["45s", "90m", "12h", "30d", "2w", "", "30", "abc", "10y"]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(durations)], "i int, s string").orderBy("i").select(exprs.duration_seconds(F.col("s"))).collect()]
    assert got == [45, 5400, 43200, 2592000, 1209600, None, None, None, None]


def test_signatures(spark):
    import hashlib
    import hmac

    for key in ("secret", "k" * 80):
        want = hmac.new(key.encode(), b"task-1", hashlib.sha256).hexdigest()
        row = one(spark, exprs.hmac_sha256(key, F.lit("task-1")), exprs.signature_matches(key, F.lit("task-1"), F.lit(want.upper())), exprs.signature_matches(key, F.lit("task-2"), F.lit(want)))
        assert list(row) == [want, True, False]
    assert one(spark, exprs.hex_decode(F.lit("0aFF")).alias("x"))["x"] == b"\x0a\xff" and one(spark, exprs.hex_decode(F.lit("0g")).alias("x"))["x"] is None


def test_errors(spark):
    row = one(spark, exprs.parse_error(F.lit('{"kind":"fetch","message":"m"}')).alias("a"), exprs.parse_error(F.lit("plain")).alias("b"), exprs.parse_error(F.lit(None).cast("string")).alias("c"))
    assert (row["a"]["kind"], row["b"]["kind"], row["b"]["message"], row["c"]) == ("fetch", "unspecified", "plain", None)
    assert list(one(spark, exprs.error_number(F.lit("cancelled")), exprs.status_code(F.lit("unknown_task")), exprs.status_code(F.lit("x")))) == [7, "not_found", "internal"]


def test_wire_view(spark):
    error = "struct<kind:string,message:string>"
    tasks = spark.createDataFrame([("done", "completed"), ("err", "cancelled"), ("run", "processing"), ("bad", "failed"), ("none", "completed")], "task_id string, state string")
    items = spark.createDataFrame([("done", 0, None), ("err", 0, ("fetch", "no")), ("run", 0, None), ("bad", 0, None), ("done", 1, ("fetch", "hidden"))], f"task_id string, idx long, error {error}")
    results = spark.createDataFrame([("done", 0, "general", "done", "out", None), ("done", 0, "nsfw", "skipped", None, None)], f"task_id string, item_idx long, label string, state string, output string, error {error}")
    got = {r["task_id"]: r for r in wire.task_view(tasks, items, results).collect()}
    assert {t: r["arm"] for t, r in got.items()} == {"done": "models", "err": "error", "run": "state", "bad": "error", "none": None}
    assert got["err"]["error_kind"] == 1 and got["bad"]["error_message"] == "the task failed" and got["run"]["state"] == 1
    assert got["done"]["models"]["general"]["output"] == "out" and got["done"]["models"]["nsfw"]["state"] == 5


@pytest.mark.parametrize("mode, kept", [("flat", {"least": 0.4, "most": 3}), ("flat", {}), ("taxonomy", {"least": 0.3}), ("softmax", {})])
def test_vectors_against_prompts(spark, monkeypatch, mode, kept):
    """Few prompts and many blocks of them against a product over all pairs."""
    from vigilframe.operators import zeroshot

    rnd = np.random.default_rng(5)
    vectors, prompts = rnd.normal(size=(40, 6)), rnd.normal(size=(33, 6))
    vectors[3], prompts[4] = 0, 0
    images = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(90, None), (None, [1.0] * 6)], "vec_id long, embedding array<double>")
    agg = lambda c: (None, "mean", "max")[c % 3]
    rows = [(ix, ix % 7 if mode == "taxonomy" else ix, agg(ix % 7), p.tolist()) for ix, p in enumerate(prompts)]
    frame = spark.createDataFrame(rows, "prompt_ix long, child_id long, agg string, prompt_embedding array<double>")

    want = set()
    for i, v in enumerate(vectors):
        if mode == "softmax":
            logits = 2.0 * prompts @ v
            scores = {ix: x for ix, x in enumerate(np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum())}
        else:
            if not v.any():
                continue
            each = {ix: 1 / (1 + np.exp(-(2 * (p @ v) / np.linalg.norm(p) / np.linalg.norm(v) - 0.5))) for ix, p in enumerate(prompts) if p.any()}
            if mode == "taxonomy":
                of = {c: [x for ix, x in each.items() if ix % 7 == c] for c in range(7)}
                each = {c: np.mean(x) if agg(c) == "mean" else max(x) for c, x in of.items()}
            scores = {c: x for c, x in each.items() if x >= kept.get("least", -1)}
        best = sorted(scores, key=lambda c: -scores[c])[: kept.get("most") or (5 if mode == "softmax" else None)]
        want |= {(i, c, round(float(scores[c]), 5)) for c in best}

    def got():
        out = zeroshot.classify_vectors(images, frame, "vec_id", mode, 2.0 if mode == "softmax" else float(np.log(2)), -0.5, **kept)
        assert "CartesianProduct" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
        return {(r["vec_id"], r["label"], round(r["score"], 5)) for r in out.collect()}

    few = got()
    assert len(few) == len(want) and {x[:2] for x in few} == {x[:2] for x in want}
    monkeypatch.setattr(zeroshot, "PROMPT_BYTES", 500)
    assert got() == few
    assert max(abs(dict(((a, b), c) for a, b, c in few)[a, b] - c) for a, b, c in want) < 2e-5
    assert zeroshot.classify_vectors(images, frame.limit(0), "vec_id", mode).count() == 0


def test_places_of_a_large_gate(spark):
    """Places counted in ranges against sorting, with ties in arrival left to one of the equal rows."""
    import random

    from vigilframe.operators import lifecycle

    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(3), i * 7919 % 100003) for i in range(3000)]
    got = lifecycle.waiting_order(spark.createDataFrame(rows, "gate string, priority int, seq long"), ["gate"]).collect()
    want = {}
    for gate in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == gate), key=lambda r: (-r[1], r[2]))
        want |= {(*r,): n + 1 for n, r in enumerate(mine)}
    assert {(r["gate"], r["priority"], r["seq"]): r["place"] for r in got} == want
    assert lifecycle.waiting_order(spark.createDataFrame([], "gate string, priority int, seq long"), ["gate"]).count() == 0


def admitted_by_loop(rows, free):
    """{key: accepted} of rows (group, seq, n), one after the other."""
    room, out = {}, {}
    for g, at, n in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        n = max(n or 0, 0)
        left = room.setdefault(g, free)
        out[g, at] = n <= left
        room[g] = left - n if out[g, at] else left
    return out


@pytest.mark.parametrize("groups, parts, pending, most", [(1, 7, 0, 40), (1, 1, 3, 40), (5, 6, 2, 30), (300, 4, 0, 5), (3, 9, 50, 40), (2, 5, 0, 1)])
def test_admission_without_a_group_in_one_task(spark, groups, parts, pending, most):
    import random

    rnd = random.Random(groups * 10 + parts)
    rows = [(rnd.randrange(groups) if groups > 1 else "one", at, rnd.choice([None, 0, -2, 1, 1, 2, 3, 7, 50])) for at in range(600)]
    rows = [(str(g) if g else None, at, n) for g, at, n in rows]
    frame = spark.createDataFrame(rows, "g string, seq long, n_items long")
    out = lifecycle.within_capacity(frame, pending, most, ["g"], parts=parts)
    got = {(r["g"], r["seq"]): r["accepted"] for r in out.collect()}
    assert got == admitted_by_loop(rows, most - pending)
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    assert lifecycle.within_capacity(frame.limit(0), pending, most, ["g"]).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-1, 5), st.integers(-20, 100).map(lambda k: k * 0.05), st.integers(0, 100).map(lambda k: k * 0.025))))
def test_first_come_against_a_loop(times):
    kept = []
    for t in times:
        if not any(c is not None and t is not None and abs(c - t) <= 0.05 for c in kept):
            kept.append(t)
    assert sampling.first_come(times) == kept


def test_plans_of_long_videos_are_linear(spark):
    import time

    began = time.monotonic()
    times = [i / 30 for i in range(100_000)]
    assert len(sampling.first_come(times)) == 50_000 and time.monotonic() - began < 1
    d = F.lit(3600.0)
    steps = F.array(sampling.at_rate(d, F.lit(30.0)), sampling.uniform(d, F.lit(5000)))
    got = one(spark, sampling.merge_steps(steps, d, F.lit(30.0)).alias("t"))["t"]
    t, want = 0.0, []
    while t < 3600.0:
        want.append(t)
        t += 1.0 / 30.0
    assert got[:50_000] == sampling.first_come([min(x, 3600 - 1 / 30) for x in want])[:50_000]
    assert one(spark, sampling.at_rate(F.lit(None).cast("double"), F.lit(1.0)).alias("a"), sampling.at_rate(d, F.lit(-1.0)).alias("b")) == ([], [])


def test_requests_become_submissions(spark):
    lines = ['{"image_url": {"main": "http://a", "fallback": "http://b"}, "models": ["m"]}', '{"text": "hi", "pipeline": "p"}', '{"audio_url": {"main": "x", "fallback": "y"}, "models": ["m"]}', '{"models": ["m"]}', '{"text": "hi"}', '{"text": "hi", "models": []}', '{"text": "hi", "video_url": {"main": "v"}, "models": ["m"]}', "nonsense", "", None, "[1]", '{"video_url": {"main": "v"}, "models": ["m", "n"], "pipeline": "p", "more": 1}']
    got = [r for r in wire.requests(spark.createDataFrame(list(enumerate(lines)), "task_id int, request string")).orderBy("task_id").collect()]
    assert [r["problem"] for r in got] == [None, None, None, "an input is required", "models or a pipeline are required", "models or a pipeline are required", "only one input is allowed", *["the request cannot be read"] * 4, None]
    assert tuple(got[0]["input"]) == ("image", "http://a", "http://b", None, None, False) and tuple(got[1]["input"]) == ("text", None, None, "hi", None, False)
    assert tuple(got[2]["input"])[:3] == ("audio", "x", "y") and got[3]["input"] is None
    assert tuple(got[11]["input"]) == ("video", "v", None, None, None, True) and (got[11]["models"], got[11]["pipeline"]) == (["m", "n"], "p")
