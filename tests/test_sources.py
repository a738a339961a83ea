"""Store, media, configuration, engine and streams."""

import pytest
from pyspark.sql import functions as F

from vigilframe.plans import classify
from vigilframe.sources import config, media
from vigilframe.sources.store import open_store
from vigilframe.streaming import scan

TOML = """
[models.general]
repo = "a/b"
strategy = "light"
[models.nsfw]
repo = "c/d"
priority = 5
[strategies.light]
steps = [{step = 1, method = "uniform", count = 3}, {step = 2, method = "fps", fps = 1.0}]
[pipelines.p]
steps = [{order = 2, model = "general"}, {order = 1, model = "nsfw"}]
"""
IMAGE = {"kind": "image", "main": "http://a/x.png", "fallback": "http://b/x.png", "text": None, "path": None, "video": False}


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_store_lifecycle(spark, tmp_path):
    clock = [100]
    s = open_store(spark, "parquet", str(tmp_path / "store"), now=lambda: clock[0])
    s.migrate()
    s.create_task("task-1", [{"input": IMAGE, "models": ["general", "nsfw"]}])
    row = s.get_task("task-1").first()
    assert {k: v["state"] for k, v in row["results"].items()} == {"general": "queued", "nsfw": "queued"}
    assert row["input"]["fallback"] == "http://b/x.png"
    s.upsert_model_result("task-1", 0, "general", "done", {"classification": [(7, 0.99)], "frame_scan": None})
    s.set_steps_completed("task-1", 0, "nsfw", 1)
    s.append_frame("task-1", 0, "nsfw", 0, 1.0, [(0, 0.1)])
    s.append_frame("task-1", 0, "nsfw", 0, 1.5, [(0, 0.8)])
    row = s.get_task("task-1").first()
    assert row["results"]["general"]["output"]["classification"][0]["label"] == 7
    assert row["results"]["nsfw"]["state"] == "processing" and s.steps_completed("task-1", 0, "nsfw") == 1
    assert s.steps_completed("task-1", 0, "lost") == 0
    s.upsert_model_result("task-1", 0, "nsfw", "failed", None, {"kind": "inference", "message": "x"})
    assert s.steps_completed("task-1", 0, "nsfw") == 1  # an upsert leaves the steps
    stored = s.load_frames("task-1", 0, "nsfw").collect()
    assert [(r["frame_index"], r["timestamp"]) for r in stored] == [(0, 1.5)]
    assert s.load_incomplete_tasks().count() == 1
    assert [s.increment_attempts("task-1"), s.increment_attempts("task-1")] == [1, 2]
    s.set_item_retries("task-1", 0, 2)
    s.set_item_state("task-1", 0, "retrying", {"kind": "fetch", "message": "x"})
    assert s.table("items").first()["error"]["kind"] == "fetch"
    s.set_item_state("task-1", 0, "completed")
    item = s.table("items").first()
    assert item["error"] is None and item["retries"] == 2
    assert s.items_pending_webhook().count() == 1
    s.mark_webhook_delivered("task-1", 0)
    assert s.items_pending_webhook().count() == 0
    s.set_task_state("task-1", "completed")
    for name in ("items", "tasks", "model_results"):
        s.compact(name)
    assert s.table("tasks").first()["attempts"] == 2 and s.get_task("task-1").count() == 1
    assert s.purge_finished_before(100) == 0 and s.purge_finished_before(110) == 1
    assert s.get_task("task-1").count() == 0 and s.table("frames").count() == 0
    s.cache_store("h", "m", "main", {"classification": [(1, 0.5)], "frame_scan": None})
    s.url_cache_store("u", "m", "main", "h")
    assert s.cache_lookup("h", "m", "main", 100)["classification"][0]["label"] == 1 and s.cache_lookup("h", "m", "main", 101) is None
    assert s.url_cache_lookup("u", "m", "main") == "h" and s.url_cache_lookup("u", "m", "other") is None
    with pytest.raises(ValueError):
        open_store(spark, "postgres", str(tmp_path))


def test_engine(spark, tmp_path):
    c = config.Config.parse(TOML)
    s = open_store(spark, "parquet", str(tmp_path / "engine"))
    e = classify.Engine(spark, s, c.models(spark), c.pipelines(spark), ("light",), max_pending=3)
    a = e.submit_one(**classify.image("http://a/x.png", models=["general"]))
    assert e.get_task(a).first()["arm"] == "state"
    b = e.submit_one(**classify.image("http://a/x.png", pipeline="p"))
    assert s.table("items").where(F.col("task_id") == b).first()["models"] == ["nsfw", "general"]
    for how, problem in ((classify.text("x", models=["general"]), "not supported"), (classify.image("http://a", models=["lost"]), "unknown model"), (classify.image("http://a", pipeline="lost"), "unknown pipeline"), (classify.image("http://a"), "models or a pipeline")):
        with pytest.raises(ValueError, match=problem):
            e.submit_one(**how)
    work = e.pending_work().collect()
    assert [r["model"] for r in work] == ["nsfw", "general", "general"]
    e.finish(spark.createDataFrame([(a, 0, "general", "done", ([(7, 0.9)], None), None)], "task_id string, item_idx bigint, label string, state string, output struct<classification:array<struct<label:bigint,score:float>>,frame_scan:string>, error struct<kind:string,message:string>").withColumn("output", F.struct("output.classification", F.lit(None).cast("struct<aggregated:array<struct<label:bigint,score:float>>,frames:array<struct<frame_index:bigint,timestamp:double,classification:array<struct<label:bigint,score:float>>>>>").alias("frame_scan"))))
    view = e.get_task(a).first()
    assert view["arm"] == "models" and view["models"]["general"]["output"]["classification"][0]["label"] == 7
    assert e.cancel(b) and not e.cancel(a)
    with pytest.raises(KeyError):
        e.cancel("lost")
    e.submit_one(**classify.video("http://a/v.mp4", models=["general"]))
    with pytest.raises(ValueError, match="queue_full"):
        e.submit(spark.createDataFrame([(f"t{i}", 0, IMAGE, ["general"], None) for i in range(4)], "task_id string, idx bigint, input struct<kind:string,main:string,fallback:string,text:string,path:string,video:boolean>, models array<string>, pipeline string"))
        e.submit_one(**classify.image("http://a/y.png", models=["general"]))
    assert {r["action"] for r in e.recover().collect()} == {"requeue"}


def test_classify_and_scan(spark):
    import numpy as np

    model = classify.batch_model(lambda: lambda images: np.array([[len(x) / 10, 1 - len(x) / 10] for x in images]))
    images = spark.createDataFrame([(1, bytearray(b"aaa")), (2, bytearray(b"aaaaaaaa"))], "item long, content binary")
    got = {r["item"]: [p["label"] for p in r["classification"]] for r in classify.classify_images(images, model, ["item"]).collect()}
    assert got == {1: [1, 0], 2: [0, 1]}
    steps = spark.createDataFrame([("s", 2, "fps", None, 1.0, None), ("s", 1, "uniform", 2, None, None)], "strategy string, step int, method string, count int, rate double, nth int")
    videos = spark.createDataFrame([(1, "s", 8.0, 30.0)], "item long, strategy string, duration double, fps double")
    planned = classify.frame_plan(videos, steps, ["item"])
    assert [r["timestamp"] for r in planned.orderBy("frame_index").collect()] == pytest.approx([2, 6, 0, 1, 3, 4, 5, 7])
    done = spark.createDataFrame([(1, 0, 2.0, [(5, 0.5)])], "item long, frame_index int, timestamp double, classification array<struct<label:bigint,score:float>>")
    run = lambda f: f.withColumn("ordinal", F.lit(0)).withColumn("label", F.lit(5).cast("bigint")).withColumn("score", (F.col("frame_index") / 4).cast("float"))
    scanned = classify.scan_videos(planned, done, run, ["item"], "max", [5], 0.7).first()["frame_scan"]
    assert [f["frame_index"] for f in scanned["frames"]] == [0, 1, 2, 3] and scanned["aggregated"][0]["score"] == pytest.approx(0.75)


def test_urls_and_addresses(spark):
    hints = one(spark, *[media.filename_hint(F.lit(u)) for u in ("http://a/b/c.png?x=1#y", "http://a/b/", "plain.png")])
    assert list(hints) == ["c.png", None, "plain.png"]
    limits = media.FetchLimits(local_roots=("/data",))
    got = [one(spark, media.resolve(F.lit(u), limits).alias("r"))["r"] for u in ("file:///data/x", "/etc/passwd", "/data/../etc/x", "ftp://a", "HTTPS://a")]
    assert [(r["kind"], r["problem"] is None) for r in got] == [("local", True), ("local", False), ("local", False), ("remote", False), ("remote", True)]
    bad = ["10.1.2.3", "127.0.0.1", "100.64.1.1", "172.31.0.1", "192.168.1.1", "169.254.1.1", "0.1.2.3", "::1", "fe80::1", "fd00::1", "ff02::1", "::ffff:10.0.0.1", "nonsense"]
    good = ["8.8.8.8", "100.128.0.1", "172.32.0.1", "2606:4700::1", "::ffff:8.8.8.8"]
    assert [one(spark, media.is_blocked_ip(F.lit(x)).alias("x"))["x"] for x in bad + good] == [True] * len(bad) + [False] * len(good)
    assert one(spark, media.vetted_address(F.array(F.lit("8.8.8.8"), F.lit("10.0.0.1"))).alias("x"))["x"] is None


def test_fetch_falls_back(spark):
    def download(url, limits):
        if "bad" in url:
            raise OSError("down")
        return url.encode()

    items = spark.createDataFrame([(1, "http://ok", None), (2, "http://bad", "http://ok2"), (3, "http://bad", "http://bad2")], "item long, main string, fallback string")
    got = {r["item"]: (r["content"], r["fetch_error"]) for r in media.fetch(items, download, media.FetchLimits()).collect()}
    assert got[1] == (b"http://ok", None) and got[2] == (b"http://ok2", None)
    assert got[3][0] is None and got[3][1] == "http://bad: down; http://bad2: down"


def test_probes(spark):
    text = '{"streams":[{"codec_type":"audio"},{"codec_type":"video","codec_name":"h264","avg_frame_rate":"0/0","r_frame_rate":"30000/1001","nb_frames":"10","width":4,"height":2,"duration":"3.5"}],"format":{"format_name":"mov,mp4"}}'
    p = one(spark, media.parse_probe(F.lit(text)).alias("p"))["p"]
    assert (p["duration"], round(p["fps"], 2), p["frame_count"], p["width"]) == (3.5, 29.97, 10, 4)
    assert one(spark, media.parse_probe(F.lit('{"streams":[]}')).alias("p"))["p"] is None
    assert one(spark, media.keyframe_times(F.lit("0.0,\nx\n1.5\n")).alias("t"))["t"] == [0.0, 1.5]
    assert one(spark, media.scene_times(F.lit("a pts_time:1.25 b pts_time:3 c")).alias("t"))["t"] == [1.25, 3.0]
    still = one(spark, *[media.is_still(F.struct(F.lit(f).alias("format"), F.lit(c).alias("codec"), F.lit(n).alias("frame_count"), F.lit(d).alias("duration"))) for f, c, n, d in (("image2", "h264", 9, 1.0), ("png_pipe", "png", 1, 0.0), ("mov", "mjpeg", 1, 0.0), ("mov", "mjpeg", 9, 3.0))])
    assert list(still) == [True, True, True, False]
    assert list(one(spark, media.scene_threshold(F.lit(float("nan"))), media.scene_threshold(F.lit(2.0)))) == [0.0, 1.0]


def test_uploads(spark):
    data = bytes(range(256)) * 600
    chunks = media.to_chunks(spark.createDataFrame([("u", bytearray(data)), ("e", bytearray(b""))], "upload_id string, data binary"))
    assert chunks.count() == 3
    rows = chunks.select("upload_id", (F.col("seq") + 1).alias("seq"), F.lit(False).alias("init"), "data")
    start = spark.createDataFrame([("u", 0, True, None), ("e", 0, True, None), ("n", 0, False, bytearray(b"x")), ("t", 0, True, None), ("t", 1, True, bytearray(b"x"))], "upload_id string, seq int, init boolean, data binary")
    got = {r["upload_id"]: r for r in media.assemble(start.union(rows), 1 << 20).collect()}
    assert got["u"]["data"] == data and got["u"]["problem"] is None
    assert "empty" in got["e"]["problem"] and "first message" in got["n"]["problem"] and "twice" in got["t"]["problem"]
    assert "too large" in media.assemble(start.union(rows), 1000).where("upload_id = 'u'").first()["problem"]


def test_configuration(spark):
    c = config.Config.parse(TOML)
    m = c.data["models"]["general"]
    assert (m["revision"], m["enabled"], m["batch_size"], m["timeout_seconds"], c.get("server.port")) == ("main", True, 8, 30, 8080)
    assert c.problems() == []
    bad = config.Config.parse('[models.a]\nrepo = "x"\nstrategy = "lost"\n[strategies.s]\nsteps = [{step = 1, method = "fps"}]')
    assert any("unknown strategy" in p for p in bad.problems()) and any("fps needs fps" in p for p in bad.problems())
    with pytest.raises(ValueError, match="unknown keys"):
        config.Config.parse("[server]\nodd = 1")
    config.Config.parse("[cache]\nodd = 1")
    assert c.override(port=1, webhook_url="x").data["server"]["port"] == 1 and "url" not in c.override(webhook_url="x").data["webhook"]
    c.set("server.port", "9000")
    assert c.get("server.port") == 9000 and c.remove("server.port") and not c.remove("server.port")
    assert [config.scalar(x) for x in ("true", "3", "0.5", "x")] == [True, 3, 0.5, "x"]
    assert config.parse_size("1.5gb") == 3 << 29 and config.parse_size("0") is None and config.parse_duration("2w") == 1209600 and config.parse_duration("30") is None
    assert config.id2label('{"id2label": {"1": "b", "0": "a", "7": "x"}}') == ["a", "b"]
    assert config.normalization('{"size": {"shortest_edge": 12}, "image_mean": [1, 2, 3]}') == {"mean": [1.0, 2.0, 3.0], "std": [0.5] * 3, "size": 12}


def test_taxonomy(spark):
    t = config.Taxonomy.parse('[food]\nid = 1\n[food.children.meals]\nid = 1001\nprompts = ["a", "b"]\naggregation = "average"\n[food.children.drinks]\nid = 1002\nprompts = ["c"]')
    assert [(r[2], r[4]) for r in t.rows] == [(1002, "max"), (1001, "mean"), (1001, "mean")] and t.frame(spark).count() == 3
    with pytest.raises(ValueError, match="taken"):
        config.Taxonomy.parse('[a]\nid = 1\n[a.children.x]\nid = 2\nprompts = ["a"]\n[a.children.y]\nid = 2\nprompts = ["b"]')


def test_stream_early_exit(spark, tmp_path):
    rows = [(1, i, s) for i, s in enumerate([0.1, 0.9, 0.2, 0.95])] + [(2, 0, 0.1), (2, 1, 0.2)]
    for part in (rows[:2] + rows[4:5], rows[2:4] + rows[5:]):
        spark.createDataFrame(part, "item long, frame_index int, score double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("item long, frame_index int, score double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = scan.stream_until_trigger(stream, "item", F.col("score") >= 0.9).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["item"], r["frame_index"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 0), (1, 1), (2, 0), (2, 1)]


def test_outbox(spark):
    def deliver(row):
        if row["task_id"] == "bad":
            raise OSError

    pending = spark.createDataFrame([("ok", 0), ("bad", 0)], "task_id string, idx long")
    got = {r["task_id"]: r["delivered"] for r in scan.outbox(pending, deliver, (0, 0)).collect()}
    assert got == {"ok": True, "bad": False}


def test_video_tools(spark):
    def run(command):
        if command[0] == "ffprobe":
            return b'{"streams":[{"codec_type":"video","codec_name":"h264","avg_frame_rate":"25/1","duration":"2"}],"format":{"format_name":"mov"}}' if "good" in command[-1] else b'{"streams":[]}'
        if "-ss" in command and float(command[command.index("-ss") + 1]) > 1.5:
            return b""
        return b"last" if "-sseof" in command else b"frame"

    df = spark.createDataFrame([("good.mp4", 1.0), ("good.mp4", 1.9), ("bad.mp4", 0.0)], "path string, timestamp double")
    got = {(r["path"], r["timestamp"]): (r["info"], r["problem"]) for r in media.probe_videos(df, run).collect()}
    assert got["good.mp4", 1.0][0]["fps"] == 25 and got["good.mp4", 1.0][1] is None and got["bad.mp4", 0.0][1] == "no video stream"
    frames = {r["timestamp"]: r["frame"] for r in media.extract_frames(df.where("path = 'good.mp4'"), run).collect()}
    assert frames == {1.0: b"frame", 1.9: b"last"}


def test_download_refuses_private_hosts():
    for address in ("10.0.0.1", "::ffff:127.0.0.1", "fe80::1"):
        with pytest.raises(ValueError, match="blocked"):
            media.http_download("http://inside/x", media.FetchLimits(), resolver=lambda h, p, a=address: ["8.8.8.8", a])
    with pytest.raises(ValueError, match="scheme"):
        media.http_download("ftp://a/x", media.FetchLimits())


def test_pixels(spark):
    import numpy as np

    from vigilframe.functions import pixels

    black = np.zeros((2, 2, 3), np.uint8)
    assert pixels.to_tensor([black, black], 4, [0.5] * 3, [0.5] * 3).shape == (2, 3, 4, 4)
    ramp = np.repeat(np.arange(4, dtype=np.uint8)[None, :, None] * 50, 4, 0).repeat(3, 2)
    assert pixels.resize(ramp, 4) is ramp and pixels.resize(ramp, 2)[0, :, 0].tolist() == pytest.approx([36, 114], abs=8)
    df = spark.createDataFrame([(bytearray(black.tobytes()), 2, 2), (None, 0, 0)], "data binary, width int, height int")
    got = [r["t"] for r in df.select(pixels.preprocess(F.col("data"), F.col("width"), F.col("height"), 4, [0.5] * 3, [0.5] * 3).alias("t")).collect()]
    assert got[0] == [-1.0] * 48 and got[1] is None


def test_a_change_that_lands_beside_a_compaction_is_kept(spark, tmp_path):
    """Drawn before the compaction, written after it; then more compactions, with old files and bases going."""
    s = open_store(spark, "parquet", str(tmp_path / "store"), now=lambda: 50)
    s.create_task("t", [{"input": None, "models": ["m"]}])
    s.set_item_state("t", 0, "processing", {"kind": "fetch", "message": "x"})
    s.increment_attempts("t")
    early = s._version()
    s.set_item_state("t", 0, "retrying")
    late = s._version()
    s.set_item_retries("t", 0, 4)
    for n in ("items", "tasks"):
        s.compact(n)
    item = lambda: s.table("items").first()
    assert (item()["state"], item()["error"], item()["retries"]) == ("retrying", None, 4)
    write = lambda version, **columns: s._write(s._rows([{"task_id": "t", "idx": 0, "_version": version, **columns}], "items"), "items", version)
    write(early, state="queued", pipeline="p")
    assert (item()["state"], item()["pipeline"]) == ("retrying", "p")  # older than the state, newer than any pipeline
    write(late, state="completed")
    assert (item()["state"], item()["retries"]) == ("completed", 4)
    before = [r.asDict(True) for n in ("items", "tasks") for r in s.table(n).collect()]
    for _ in range(3):
        for n in ("items", "tasks"):
            s.compact(n)
        assert [r.asDict(True) for n in ("items", "tasks") for r in s.table(n).collect()] == before
    assert len(list((tmp_path / "store" / "items").glob("base-*"))) == 2 and not list((tmp_path / "store" / "items" / "tail").glob("_day=[1-9]*/*.parquet"))
    s.set_task_state("t", "completed")
    assert s.purge_finished_before(60) == 1 and s.table("items").count() == 0
    for _ in range(3):
        for n in ("items", "tasks"):
            s.compact(n)
        assert s.table("items").count() == s.table("tasks").count() == 0
    half = tmp_path / "store" / "items" / "base-99999999999999999999"
    half.mkdir()  # a compaction that died before its end
    assert s.table("items").count() == 0


def test_staged_downloads_hold_a_piece_at_a_time(spark, tmp_path):
    """400 MB pass through a process that grows by less than a tenth of it; caps, failures and fallbacks are rows' errors."""
    import hashlib
    import subprocess
    import sys

    code = f"""
import resource
from vigilframe.sources import media
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
path, n, digest = media.stage_one("big", {str(tmp_path / "big")!r}, media.FetchLimits(), lambda url, limits: (b"x" * (1 << 16) for _ in range(6400)))
assert n == 6400 << 16
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 40 << 10
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)

    def stream(url, limits):
        if "down" in url:
            raise OSError("unreachable")
        for k in range(int(url.rsplit("/", 1)[1])):
            yield b"%04d" % k
        if "torn" in url:
            raise OSError("connection lost")

    folder = str(tmp_path / "staged")
    rows = [(0, "http://a/3", None), (1, "http://a/3", "http://b/9"), (2, "http://down/1", "http://b/2"), (3, "http://down/1", None), (4, "http://b/99", None), (5, "http://torn/2", "http://down/3"), (6, None, None), (7, "http://a/0", None)]
    rows += [(100 + i, "http://hot/5", None) for i in range(40)]
    out = media.staged_downloads(spark.createDataFrame(rows, "n int, main string, fallback string"), folder, media.FetchLimits(most_bytes=100), stream)
    got = {r["n"]: r for r in out.collect()}
    body = lambda n: b"".join(b"%04d" % k for k in range(n))
    for n, pieces in ((0, 3), (1, 3), (2, 2), (7, 0), (100, 5), (139, 5)):
        assert (got[n]["length"], got[n]["content_hash"], got[n]["fetch_error"]) == (4 * pieces, hashlib.sha256(body(pieces)).hexdigest(), None)
        assert open(got[n]["path"], "rb").read() == body(pieces)
    assert got[3]["fetch_error"] == "http://down/1: unreachable" and got[6]["fetch_error"] == "no source"
    assert "too large" in got[4]["fetch_error"] and "connection lost" in got[5]["fetch_error"] and "http://down/3: unreachable" in got[5]["fetch_error"]
    assert len(list((tmp_path / "staged").iterdir())) == 4  # equal contents are one file, and no part is left


def test_lookups_read_the_log_of_their_keys_only(spark, tmp_path):
    s = open_store(spark, "parquet", str(tmp_path / "store"), now=lambda: 7)
    out = {"classification": [{"label": 1, "score": 0.5}], "frame_scan": None}
    with s.batch():
        for k in range(6):
            s.cache_store(f"h{k}", "m", "main", out)
    s.cache_store("h1", "m", "main", out | {"classification": []})
    only = spark.createDataFrame([("h1",), ("h1",), ("h9",)], "content_hash string")
    table = s.table("cache", only)
    assert [(r["content_hash"], r["output"]["classification"]) for r in table.collect()] == [("h1", [])]
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi") and "BroadcastHashJoin" in plan  # below the aggregate
    # a compacted cache is read in the folders of the keys asked for
    everything = {r["content_hash"]: r["output"] for r in s.table("cache").collect()}
    for _ in range(2):
        s.compact("cache")
        assert {r["content_hash"]: r["output"] for r in s.table("cache").collect()} == everything
    few = s.table("cache", only)
    assert [(r["content_hash"], r["output"]["classification"]) for r in few.collect()] == [("h1", [])]
    folders = {f.rsplit("/", 2)[-2] for f in few.inputFiles() if "/base-" in f}
    assert len(folders) == 1 and len({f.rsplit("/", 2)[-2] for f in s.table("cache").inputFiles() if "/base-" in f}) > 3
    s.cache_store("h9", "m", "main", out)
    assert sorted(r["content_hash"] for r in s.table("cache", only).collect()) == ["h1", "h9"]
    s.compact("url_cache")
    assert s.table("url_cache").count() == 0 and s.table("url_cache", spark.createDataFrame([("x",)], "url_hash string")).count() == 0


def test_large_logs_are_sorted_in_parts_by_their_size(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from vigilframe.sources import store as module

    monkeypatch.setattr(module, "PART_BYTES", 4096, raising=False)
    s = module.open_store(spark, "parquet", str(tmp_path / "store"), now=lambda: 1000)
    none = F.lit(None).cast("string")
    image = F.struct(F.lit("image").alias("kind"), F.concat(F.lit("http://host/"), "task_id").alias("main"), none.alias("fallback"), none.alias("text"), none.alias("path"), F.lit(False).alias("video"))
    tasks = spark.range(6000).select(F.col("id").cast("string").alias("task_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("idx"))
    s.create_tasks(tasks.select("task_id", "idx", image.alias("input"), F.array(F.lit("m")).alias("models"), none.alias("pipeline")))
    few = s.table("items").rdd.getNumPartitions()
    s.append("items", tasks.select("task_id", "idx", F.when(F.col("idx") == 1, "completed").alias("state"), F.sha2("task_id", 256).alias("pipeline")))
    many = s.table("items").rdd.getNumPartitions()
    assert 4 < few < many  # the session has 4
    states = lambda: sorted(tuple(r) for r in s.table("items").groupBy("state").count().collect())
    assert states() == [("completed", 6000), ("queued", 6000)]
    s.append("tasks", tasks.where("idx = 0 and task_id < '3'").select("task_id", F.lit("completed").alias("state"), F.lit(10).alias("updated_at")))
    n = s.purge_finished_before(1001)
    assert n == sum(str(i) < "3" for i in range(6000))
    assert states() == [("completed", 6000 - n), ("queued", 6000 - n)]
    s.compact("items")
    s.append("items", tasks.where("task_id = '5'").select("task_id", "idx", F.lit("failed").alias("state")))
    assert states() == [("completed", 5999 - n), ("failed", 2), ("queued", 5999 - n)]
    assert s.table("items").rdd.getNumPartitions() > 4


def test_tasks_are_made_and_rolled_up_in_parts_by_size(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from vigilframe.sources import store as module

    monkeypatch.setattr(module, "PART_BYTES", 1 << 18)
    s = module.open_store(spark, "parquet", str(tmp_path / "store"), now=lambda: 1000)
    none = F.lit(None).cast("string")
    image = F.struct(F.lit("image").alias("kind"), F.concat(*(F.sha2(F.concat_ws("-", "task_id", "idx"), n) for n in (256, 512))).alias("main"), none.alias("fallback"), none.alias("text"), none.alias("path"), F.lit(False).alias("video"))
    items = spark.range(4000).select(F.col("id").cast("string").alias("task_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("idx"))
    made, append = {}, s.append

    def counted(name, rows):
        made[name] = rows.rdd.getNumPartitions()
        append(name, rows)

    monkeypatch.setattr(s, "append", counted)
    s.create_tasks(items.select("task_id", "idx", image.alias("input"), F.array(F.lit("m")).alias("models"), none.alias("pipeline")))
    assert made["tasks"] > 4  # the session has 4
    s.append("items", items.where("idx < 2 or cast(task_id as int) % 3 = 0").select("task_id", "idx", F.lit("completed").alias("state")))
    rolled = s.rolled_up()
    assert rolled.rdd.getNumPartitions() > 4
    want = {str(i): "processing" if i % 3 else "completed" for i in range(4000)}
    assert {r["task_id"]: r["state"] for r in rolled.collect()} == want
    few = spark.createDataFrame([("3",), ("4",), ("none",)], "task_id string")
    assert sorted((r["task_id"], r["state"], r["_was"]) for r in s.rolled_up(few).collect()) == [("3", "completed", "queued"), ("4", "processing", "queued")]


def test_fetched_contents_leave_a_worker_piece_by_piece(spark):
    import re

    def download(url, limits):
        now = int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1])
        return str(now).encode().ljust(1 << 20)

    rows = spark.range(400).coalesce(1).selectExpr("id", "concat('http://host/', id) AS main", "cast(null AS string) AS fallback")
    got = media.fetch(rows, download, media.FetchLimits())
    seen = [int(r[0]) for r in got.selectExpr("trim(cast(substring(content, 1, 20) AS string)) AS c", "fetch_error").where("fetch_error is null").collect()]
    assert len(seen) == 400
    assert max(seen) - min(seen) < 150_000  # KB; all contents together are 400 MB
