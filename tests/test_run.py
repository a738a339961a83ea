"""Queued work run end to end: caches, retries, pipelines, videos, failures, cancellation, recovery."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilframe.plans import classify
from vigilframe.plans.run import Runner
from vigilframe.sources import config, media
from vigilframe.sources.store import open_store

TOML = """
[models.general]
repo = "a/b"
strategy = "light"
batch_size = 1
[models.nsfw]
repo = "c/d"
priority = 5
strategy = "light"
batch_size = 1
labels = [1]
trigger_threshold = 0.8
timeout_seconds = 1
[models.broken]
repo = "e/f"
[strategies.light]
early_exit = true
aggregation = "max"
steps = [{step = 1, method = "fps", fps = 1.0}]
[pipelines.p]
steps = [{order = 2, model = "general"}, {order = 1, model = "nsfw", stop_if = {labels = [1], threshold = 0.8}}]
[pipelines.q]
steps = [{order = 1, model = "broken"}, {order = 2, model = "general"}]
"""
ROWS = "task_id string, idx bigint, input struct<kind:string,main:string,fallback:string,text:string,path:string,video:boolean>, models array<string>, pipeline string"


def image(main, fallback=None):
    return ("image", main, fallback, None, None, False)


def scores(images):
    """A model that reads its answer from the bytes: `x:0.9` scores label 1 with 0.9."""
    out = []
    for x in images:
        text = bytes(x).decode()
        if "slow" in text:
            time.sleep(2.5)
        if "poison" in text:
            raise RuntimeError("cannot look at this")
        score = float(text.rsplit(":", 1)[1])
        out.append([1 - score, score])
    return np.array(out)


def failing(_):
    raise RuntimeError("no luck")


def download(url, limits):
    if "down" in url:
        raise OSError("unreachable")
    return url.rsplit("/", 1)[1].encode()


def refuse(data):
    if b"torn" in data:
        raise ValueError("cannot decode")


def tool(command):
    if command[0] == "ffprobe":
        with open(command[-1], "rb") as f:
            name = f.read().decode()
        seconds = name.split("s", 1)[0]
        return json.dumps({"streams": [{"codec_type": "video", "codec_name": "h264", "avg_frame_rate": "25"}] if "still" not in name else [], "format": {"format_name": "mov", "duration": seconds}}).encode()
    if "-sseof" in command:
        return b""
    at = float(command[command.index("-ss") + 1])
    with open(command[command.index("-i") + 1], "rb") as f:
        name = f.read().decode()
    return b"" if "dark" in name and at >= 2 else f"frame:{0.9 if at >= 3 else 0.1 * at}".encode()


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    (folder / "upload.bin").write_bytes(b"up:0.7")
    c = config.Config.parse(TOML)
    clock = [1000]
    s = open_store(spark, "parquet", str(folder / "store"), now=lambda: clock[0])
    e = classify.Engine(spark, s, c.models(spark), c.pipelines(spark), ("light",))
    video = lambda main: ("video", main, None, None, None, True)
    work = [
        ("plain", 0, image("http://a/x:0.9"), ["general", "nsfw"], None),
        ("two", 0, image("http://a/x:0.9"), ["general"], None),
        ("two", 1, image("http://down/x:0.2", "http://b/y:0.2"), ["general"], None),
        ("lost", 0, image("http://down/1", "http://down/2"), ["general"], None),
        ("torn", 0, image("http://a/torn:0.1"), ["general"], None),
        ("gate", 0, image("http://a/g:0.95"), [], "p"),
        ("pass", 0, image("http://a/h:0.3"), [], "p"),
        ("strict", 0, image("http://a/i:0.3"), [], "q"),
        ("mixed", 0, image("http://a/j:0.4"), ["broken", "general"], None),
        ("poison", 0, image("http://a/poison:0.4"), ["general"], None),
        ("slow", 0, image("http://a/slow:0.4"), ["nsfw"], None),
        ("film", 0, video("http://a/6s"), ["general", "nsfw"], None),
        ("dark", 0, video("http://a/4s-dark"), ["general"], None),
        ("long", 0, video("http://a/9999s"), ["general"], None),
        ("still", 0, video("http://a/5s-still"), ["general"], None),
        ("bytes", 0, ("bytes", None, None, None, str(folder / "upload.bin"), False), ["general"], None),
        ("gone", 0, image("http://a/z:0.1"), ["general"], None),
    ]
    accepted, rejected = e.submit(spark.createDataFrame(work, ROWS))
    assert (accepted.count(), rejected.count()) == (len(work), 0)
    assert e.cancel("gone")
    waits = []
    told = str(folder / "told")

    def notify(row):
        with open(f"{told}-{row['task_id']}-{row['idx']}-{row['state']}", "w"):
            pass

    r = Runner(e, c, {"general": lambda: scores, "nsfw": lambda: scores, "broken": lambda: failing}, download, check=refuse, tool=tool, most_seconds=3600, retries=2, wait=waits.append, notify=notify)
    ended = {(x["task_id"], x["idx"]): x["state"] for x in r.run().collect()}
    results = {(x["task_id"], x["item_idx"], x["label"]): x for x in s.table("model_results").collect()}
    items = {(x["task_id"], x["idx"]): x for x in s.table("items").collect()}
    tasks = {x["task_id"]: x["state"] for x in s.table("tasks").collect()}
    return {"engine": e, "store": s, "config": c, "runner": r, "ended": ended, "results": results, "items": items, "tasks": tasks, "waits": waits, "clock": clock, "folder": folder}


def states(ran, task, idx=0):
    return {label: r["state"] for (t, i, label), r in ran["results"].items() if (t, i) == (task, idx)}


def test_images_and_states(ran):
    assert states(ran, "plain") == {"general": "done", "nsfw": "done"} and ran["items"]["plain", 0]["state"] == "completed" and ran["tasks"]["plain"] == "completed", ran["results"]["plain", 0, "general"]
    top = ran["results"]["plain", 0, "nsfw"]["output"]["classification"]
    assert [(p["label"], round(p["score"], 3)) for p in top] == [(1, 0.9), (0, 0.1)]
    assert round(ran["results"]["two", 1, "general"]["output"]["classification"][0]["score"], 3) == 0.8  # by the fallback
    assert states(ran, "bytes") == {"general": "done"} and not (ran["folder"] / "upload.bin").exists()
    view = ran["engine"].get_task("plain").first()
    assert view["arm"] == "models" and view["models"]["general"]["output"]["classification"][0]["label"] == 1


def test_failures_and_retries(ran):
    for task, word in (("lost", "unreachable"), ("torn", "cannot decode"), ("long", "over the 3600s limit"), ("still", "no video stream")):
        item = ran["items"][task, 0]
        assert item["state"] == "failed" and item["error"]["kind"] == "fetch" and word in item["error"]["message"] and item["retries"] == 2
        assert states(ran, task) == {"general": "failed"} and ran["tasks"][task] == "completed"
    assert len(ran["waits"]) >= 4 and all(0 <= w <= 2 for w in ran["waits"])
    assert states(ran, "mixed") == {"broken": "failed", "general": "done"} and ran["items"]["mixed", 0]["state"] == "completed"
    assert ran["results"]["mixed", 0, "broken"]["error"]["message"] == "no luck"
    assert ran["results"]["poison", 0, "general"]["error"]["message"] == "cannot look at this"
    assert "timed out" in ran["results"]["slow", 0, "nsfw"]["error"]["message"]


def test_changes_are_told(ran):
    told = {p.name.removeprefix("told-") for p in ran["folder"].glob("told-*")}
    assert "plain-0-processing" in told and "lost-0-retrying" in told and "two-1-retrying" not in told and not any(x.startswith("gone") for x in told)


def test_pipelines(ran):
    assert states(ran, "gate") == {"nsfw": "done", "general": "skipped"} and ran["items"]["gate", 0]["state"] == "completed"
    assert states(ran, "pass") == {"nsfw": "done", "general": "done"}
    assert states(ran, "strict") == {"broken": "failed", "general": "failed"} and ran["items"]["strict", 0]["state"] == "failed"
    assert ran["items"]["strict", 0]["error"]["message"] == "no luck" and ran["items"]["strict", 0]["retries"] == 2


def test_videos(ran):
    scan = ran["results"]["film", 0, "nsfw"]["output"]["frame_scan"]
    assert [f["frame_index"] for f in scan["frames"]] == [0, 1, 2, 3]  # the fourth fires
    assert round(scan["aggregated"][0]["score"], 2) == 1.0 and round({p["label"]: p["score"] for p in scan["aggregated"]}[1], 2) == 0.9
    assert len(ran["results"]["film", 0, "general"]["output"]["frame_scan"]["frames"]) == 6
    assert ran["results"]["dark", 0, "general"]["state"] == "failed" and "no frame" in ran["results"]["dark", 0, "general"]["error"]["message"]
    assert ran["store"].load_frames("film", 0, "nsfw").count() == 4


def test_cancelled_task(ran):
    assert ran["tasks"]["gone"] == "cancelled" and ran["items"]["gone", 0]["state"] == "cancelled" and states(ran, "gone") == {}
    assert ("gone", 0) not in ran["ended"] and len(ran["ended"]) == len(ran["items"]) - 1


def test_caches_and_a_second_pass(spark, ran):
    e, s = ran["engine"], ran["store"]

    def never(url, limits):
        raise AssertionError("must not be fetched")

    r = Runner(e, ran["config"], {"general": lambda: failing}, never, retries=0, tool=tool)
    assert r.run().count() == 0  # nothing waits
    e.submit(spark.createDataFrame([("again", 0, image("http://a/x:0.9"), ["general"], None), ("other", 0, image("http://c/x:0.9"), ["general"], None)], ROWS))
    assert {tuple(x) for x in r.run().collect()} == {("again", 0, "completed"), ("other", 0, "failed")}  # the first by its URL
    e.submit(spark.createDataFrame([("same", 0, image("http://c/x:0.9"), [], "p"), ("same", 1, image("http://d/x:0.9"), ["general"], None)], ROWS))
    r = Runner(e, ran["config"], {"general": lambda: failing, "nsfw": lambda: failing}, download, retries=0, tool=tool, slots=1)
    first = [tuple(x) for x in r.run().collect()]
    assert first == [("same", 0, "completed")]  # the higher priority; its bytes are known under another URL
    assert [tuple(x) for x in r.run().collect()] == [("same", 1, "completed")] and r.run().count() == 0
    got = {x["label"]: x["state"] for x in s.table("model_results").where("task_id = 'same' and item_idx = 0").collect()}
    assert got == {"nsfw": "done", "general": "skipped"}  # the cached output fires the gate


def test_recovery(spark, ran):
    e, s, clock = ran["engine"], ran["store"], ran["clock"]
    staged = ran["folder"] / "staged"
    staged.mkdir()
    for name in ("needed", "orphan"):
        (staged / name).write_bytes(b"x:0.1")
    e.submit(spark.createDataFrame([("open", 0, ("bytes", None, None, None, str(staged / "needed"), False), ["general"], None)], ROWS))
    sent = str(ran["folder"] / "sent")

    def deliver(row):
        with open(f"{sent}-{row['task_id']}-{row['idx']}", "w") as f:
            f.write(row["state"])

    uploads = spark.createDataFrame([(str(staged / n),) for n in ("needed", "orphan")], "path string")
    got = [tuple(x) for x in e.recover(deliver, uploads).collect()]
    assert got == [("open", 1, "requeue")] and (staged / "needed").exists() and not (staged / "orphan").exists()
    assert (ran["folder"] / "sent-plain-0").read_text() == "completed" and s.items_pending_webhook().count() == 0
    for _ in range(2):
        e.recover()
    assert [tuple(x) for x in e.recover().collect()] == [("open", 4, "fail")] and s.table("tasks").where("task_id = 'open'").first()["state"] == "failed"
    before = {n: sorted(map(str, s.table(n).collect())) for n in ("tasks", "items", "model_results", "frames", "cache", "url_cache")}
    for n in before:
        s.compact(n)
    assert before == {n: sorted(map(str, s.table(n).collect())) for n in before}
    clock[0] += 100
    e.submit(spark.createDataFrame([("late", 0, image("http://a/x:0.9"), ["general"], None)], ROWS))
    assert s.table("tasks").count() == len(before["tasks"]) + 1


def test_admission_in_order_of_arrival(spark):
    from vigilframe.operators import lifecycle

    sizes = {"a": 5, "b": 9, "c": 4, "d": 3, "e": 1, "f": 0}
    rows = spark.createDataFrame([("g", k, n) for k, n in sizes.items()], "g string, seq string, n_items int")
    want, used = [], 2
    for k, n in sizes.items():
        if used + n <= 12:
            want.append(k)
            used += n
    assert sorted(r["seq"] for r in lifecycle.admit_in_order(rows, 2, 12, "seq", "n_items").collect()) == want == ["a", "c", "e", "f"]
    assert sorted(r["seq"] for r in lifecycle.within_capacity(rows, 2, 12, ["g"]).where("accepted").collect()) == want
    assert lifecycle.admit_in_order(rows, 0, 0, "seq", "n_items").count() == 6


def test_download_goes_to_the_vetted_address():
    import http.server
    import threading

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(302 if "moved" in self.path else 200)
            self.end_headers()
            self.wfile.write(f"{self.headers['Host']} {self.path}".encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    port, asked = server.server_address[1], []

    def resolver(host, port):
        asked.append(host)
        return ["127.0.0.1"]

    open_limits = media.FetchLimits(block_private=False)
    try:
        assert media.http_download(f"http://name.invalid:{port}/a?b", open_limits, resolver=resolver) == f"name.invalid:{port} /a?b".encode() and asked == ["name.invalid"]
        with pytest.raises(ValueError, match="302"):
            media.http_download(f"http://name.invalid:{port}/moved", open_limits, resolver=resolver)
        with pytest.raises(ValueError, match="too large"):
            media.http_download(f"http://name.invalid:{port}/a", media.FetchLimits(block_private=False, most_bytes=3), resolver=resolver)
        with pytest.raises(ValueError, match="blocked"):
            media.http_download(f"http://name.invalid:{port}/a", media.FetchLimits(), resolver=resolver)
    finally:
        server.shutdown()


def test_local_paths_are_real_paths(spark, tmp_path):
    inside, outside = tmp_path / "in", tmp_path / "out"
    inside.mkdir(), outside.mkdir()
    (inside / "a").write_bytes(b"a"), (outside / "b").write_bytes(b"b")
    (inside / "link").symlink_to(outside / "b")
    limits = media.FetchLimits(local_roots=(str(inside),))
    assert media.read_path(str(inside / "a"), limits) == b"a"
    for path in (inside / "link", outside / "b", inside / ".." / "out" / "b"):
        with pytest.raises(ValueError, match="outside"):
            media.read_path(str(path), limits)
    with pytest.raises(ValueError, match="no such"):
        media.read_path(str(inside / "lost"), limits)
    items = spark.createDataFrame([(1, str(inside / "a"), None), (2, f"file://{inside}/link", str(inside / "a")), (3, str(outside / "b"), None)], "n int, main string, fallback string")
    got = {r["n"]: (r["content"], r["fetch_error"]) for r in media.fetch(items, download, limits).collect()}
    assert got[1][0] == got[2][0] == b"a" and "outside" in got[3][1]


def test_ipv6_addresses_against_the_standard_library(spark):
    import ipaddress
    import random

    rnd = random.Random(3)
    cases = ["::1", "0:0:0:0:0:0:0:1", "0::1", "::0", "::", "::ffff:7f00:1", "0:0:0:0:0:ffff:127.0.0.1", "::ffff:8.8.8.8", "::ffff:0808:0808", "2606:4700::1", "fe80::1%eth0", "FEBF::1", "fec0::1", "fc00::", "fdff::2", "ff02::1", "1::2::3", "1:2:3", ":::1", "12345::", "::10.0.0.1", "g::1", "1:2:3:4:5:6:7:8:9", "::1:", "2001:db8::"]
    cases += [str(ipaddress.IPv6Address(rnd.getrandbits(128) >> rnd.choice([0, 0, 64, 96, 120]))) for _ in range(60)]

    def number(x):
        try:
            return f"{int(ipaddress.IPv6Address(x.split('%')[0])):032x}"
        except ValueError:
            return None

    got = {r["ip"]: r for r in spark.createDataFrame([(c,) for c in cases], "ip string").select("ip", media.ipv6_number(F.col("ip")).alias("n"), media.is_blocked_ip(F.col("ip")).alias("blocked")).collect()}
    for c in cases:
        want = number(c)
        assert got[c]["n"] == want, c
        assert got[c]["blocked"] == (want is None or media._is_private(ipaddress.IPv6Address(int(want, 16)))), c


def test_prompts_have_one_length(spark):
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace

    from vigilframe.operators import zeroshot

    def load():
        t = Tokenizer(WordLevel({"[UNK]": 0, "a": 5, "photo": 6, "of": 7, "dog": 8}, unk_token="[UNK]"))
        t.pre_tokenizer = Whitespace()
        return t

    df = spark.createDataFrame([(0, "a photo of a dog"), (1, "dog"), (2, ""), (3, None), (4, "a " * 200)], "n int, p string")
    got = {r["n"]: r["ids"] for r in df.select("n", zeroshot.prompt_tokens(load, 4)("p").alias("ids")).collect()}
    assert got == {0: [5, 6, 7, 5], 1: [8, 0, 0, 0], 2: [0] * 4, 3: None, 4: [5] * 4}
    assert len(df.where("n = 1").select(zeroshot.prompt_tokens(load, 0)("p")).first()[0]) == 64


def test_received_signatures(spark, tmp_path):
    import hashlib
    import hmac

    from vigilframe.streaming import scan

    sign = lambda key, task: hmac.new(key.encode(), task.encode(), hashlib.sha256).hexdigest()
    rows = [("a", sign("k", "a")), ("b", sign("k", "b").upper()), ("c", sign("other", "c")), ("d", None), ("e", "xyz"), ("f", sign("k", "a"))]
    df = spark.createDataFrame(rows, "task_id string, signature string")
    got = {r["task_id"]: r["problem"] for r in scan.verified(df, "k").collect()}
    assert got == {"a": None, "b": None, "c": "invalid signature", "d": "missing signature", "e": "malformed signature", "f": "invalid signature"}
    assert scan.verified(df, None).where("problem is not null").count() == 0
    df.write.parquet(str(tmp_path / "in"))
    handled = []
    q = scan.start_receiver(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", lambda rows: handled.extend(r["task_id"] for r in rows.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(handled) == ["a", "b"]


def test_places_in_the_queue_go_by_arrival(spark, tmp_path):
    c = config.Config.parse(TOML)
    s = open_store(spark, "parquet", str(tmp_path / "store"))
    e = classify.Engine(spark, s, c.models(spark), c.pipelines(spark), ("light",), max_pending=3)
    row = lambda t, i=0: (t, i, image("http://a/x:0.1"), ["general"], None)
    accepted, rejected = e.submit(spark.createDataFrame([row("z"), row("y", 0), row("y", 1), row("y", 2), row("b"), row("x", 0), row("c"), row("a")], ROWS).coalesce(1))
    assert [r["task_id"] for r in accepted.orderBy("task_id").collect()] == ["b", "x", "z"]  # a refused large one leaves room
    assert {(r["task_id"], r["problem"]) for r in rejected.collect()} == {(t, "queue_full") for t in "acy"}
    e = classify.Engine(spark, s, c.models(spark), c.pipelines(spark), ("light",), max_pending=4)
    late = spark.createDataFrame([(*row("d"), 9), (*row("e"), 4)], ROWS + ", arrival bigint")
    assert [r["task_id"] for r in e.submit(late)[0].collect()] == ["e"]


# --- scans, architectures, permits, retries


def counted(folder, answer):
    """A model that leaves a file for every batch it is asked, named by what it saw."""

    def predict(images):
        import uuid

        with open(f"{folder}/{uuid.uuid4()}", "w") as f:
            f.write("\n".join(bytes(x).decode() for x in images))
        return answer(images)

    return predict


def seen(folder):
    return [p.read_text().split("\n") for p in folder.iterdir()]


SCANS = """
[models.m]
repo = "a/b"
strategy = "s"
batch_size = 2
labels = [1]
trigger_threshold = 0.8
[strategies.s]
early_exit = true
aggregation = "max"
steps = [{step = 1, method = "fps", fps = 1.0}]
"""


def test_no_frame_beyond_the_batch_that_fires_is_asked_for(spark, tmp_path):
    """30 frames of which the eleventh fires, by batches of two; then a pass that dies and one that goes on."""
    (tmp_path / "asked").mkdir()
    c = config.Config.parse(SCANS)
    s = open_store(spark, "parquet", str(tmp_path / "store"))
    e = classify.Engine(spark, s, c.models(spark), c.pipelines(spark), ("s",))
    film = ("video", "http://a/30s", None, None, None, True)
    e.submit(spark.createDataFrame([("film", 0, film, ["m"], None)], ROWS))
    asked = str(tmp_path / "asked")
    at = lambda images: np.array([[0.0, 0.9 if float(bytes(x).decode().split(":")[1]) >= 10 else 0.1] for x in images])

    def every_second(command):
        if command[0] == "ffprobe":
            return tool(command)
        return f"t:{command[command.index('-ss') + 1]}".encode()

    r = Runner(e, c, {"m": lambda: counted(asked, at)}, download, tool=every_second, cache=False, most_batches=2)
    rounds = []
    append = s.append

    def dying(name, rows):
        append(name, rows)
        if name == "frames":
            rounds.append(rows.count())
            if len(rounds) == 2:
                raise RuntimeError("the driver is gone")

    s.append = dying
    with pytest.raises(RuntimeError, match="gone"):
        r.run()
    s.append = append
    assert rounds == [2, 4]  # a batch, then two
    first = sorted(x for b in seen(tmp_path / "asked") for x in b)
    assert first == [f"t:{t:.6f}" for t in range(6)]
    assert s.load_frames("film", 0, "m").count() == 6
    r.run()
    everything = sorted((x for b in seen(tmp_path / "asked") for x in b), key=lambda x: float(x[2:]))
    assert everything == [f"t:{t:.6f}" for t in range(12)]  # each frame once, none beyond the batch of the eleventh
    scan = s.table("model_results").first()["output"]["frame_scan"]
    assert [f["frame_index"] for f in scan["frames"]] == list(range(11)) and scan["aggregated"][0]["label"] == 1


def test_scans_of_rows_ask_batch_by_batch(spark):
    from vigilframe.operators import pool

    frames = spark.createDataFrame([(k, i, float(i == fire)) for k, (n, fire) in enumerate([(3, None), (100, 0), (100, 7), (100, 8), (100, 60), (8, 7), (9, None)]) for i in range(n)], "item long, frame_index long, score double")
    stored, asked = [], []

    def classify_(rows):
        asked.append(rows.count())
        return rows.withColumn("fires", F.col("score") > 0.5)

    kept, counts = pool.scan_in_batches(frames, ["item"], classify_, lambda df: df.cache(), store=lambda rows: stored.append(rows.count()))
    assert {r["item"]: r["n_classified"] for r in counts.collect()} == {0: 3, 1: 8, 2: 8, 3: 24, 4: 100, 5: 8, 6: 9}
    assert {r["item"]: r["n"] for r in kept.groupBy("item").agg(F.count("*").alias("n")).collect()} == {0: 3, 1: 1, 2: 8, 3: 9, 4: 61, 5: 8, 6: 9}
    assert asked == [3 + 8 * 6, 16 * 2 + 1, 32, 44] and sum(stored) == 99
    none, counts = pool.scan_in_batches(frames.limit(0), ["item"], classify_, lambda df: df)
    assert none.count() == 0 and counts.count() == 0


ARCHITECTURES = """
[models.vit]
repo = "a/a"
[models.flat]
repo = "a/b"
architecture = "siglip"
prompts = ["red", "green", "blue"]
template = "a {} thing"
max_results = 2
score_threshold = 0.3
[models.tree]
repo = "a/c"
architecture = "siglip"
taxonomy = "tree.toml"
score_threshold = 0.4
"""
TREE = """
[warm]
id = 1
[warm.children.fire]
id = 1001
aggregation = "mean"
prompts = ["red", "blue"]
[warm.children.sun]
id = 1002
prompts = ["red", "green"]
"""


def test_architectures_in_one_run(spark, tmp_path):
    """Logits through a softmax, prompts by threshold and cap, and a taxonomy by threshold without a cap."""
    from vigilframe.functions import heads

    (tmp_path / "tree.toml").write_text(TREE)
    c = config.Config.parse(ARCHITECTURES, str(tmp_path))
    s = open_store(spark, "parquet", str(tmp_path / "store"))
    e = classify.Engine(spark, s, c.models(spark), c.pipelines(spark))
    told = str(tmp_path / "texts")

    def siglip():
        def texts(prompts):
            with open(told, "a") as f:
                f.write("|".join(prompts) + "\n")
            words = ["red", "green", "blue"]
            return np.array([[float(w in p) for w in words] for p in prompts])

        return heads.Siglip(lambda images: np.array([[float(x) for x in bytes(i).decode().split(":")[1].split(",")] for i in images]), texts, np.log(4.0), -1.0)

    vit = lambda: heads.Vit(lambda images: np.array([[0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 20.0]] * len(images)))
    e.submit(spark.createDataFrame([("a", 0, image("http://a/x:3,4,0"), ["vit", "flat", "tree"], None), ("b", 0, image("http://a/x:0,0,-1"), ["flat", "tree"], None)], ROWS))
    r = Runner(e, c, {"vit": vit, "flat": siglip, "tree": siglip}, download, tool=tool)
    assert sorted(tuple(x) for x in r.run().collect()) == [("a", 0, "completed"), ("b", 0, "completed")]
    got = {(x["task_id"], x["label"]): [(p["label"], round(p["score"], 4)) for p in x["output"]["classification"]] for x in s.table("model_results").collect()}
    sig = lambda cosine: round(float(np.float32(1 / (1 + np.exp(-(4 * cosine - 1))))), 4)
    assert [n for n, _ in got["a", "vit"]] == [6, 5, 4, 3, 2] and got["a", "vit"][0][1] == 1.0
    assert got["a", "flat"] == [(1, sig(0.8)), (0, sig(0.6))]  # blue scores sigmoid(-1), below the threshold
    mean = round(float(np.float32((1 / (1 + np.exp(-1.4)) + 1 / (1 + np.exp(1.0))) / 2)), 4)
    assert got["a", "tree"] == [(1002, sig(0.8)), (1001, mean)]
    assert got["b", "flat"] == got["b", "tree"] == []  # its cosines are 0 and -1
    assert set(open(told).read().split()) >= {"a"} and "a red thing|a green thing|a blue thing" in open(told).read() and "red|blue|red|green" in open(told).read()


def test_batches_go_on_over_arrow_batches_and_idle_weights_go(spark, tmp_path):
    from vigilframe.plans import worker

    folder = str(tmp_path)
    model = worker.Model(lambda: counted(folder, scores), batch_size=8, name="counted")
    rows = spark.range(0, 50, 1, 2).select("id", F.when(F.col("id") % 10 != 9, F.concat(F.lit("x:0."), F.col("id") % 9).cast("binary")).alias("content"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = rows.select("id", model(F.col("content")).alias("r")).select("id", "r.*").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r["id"] for r in got] == list(range(50))
    assert [round(r["classification"][0]["score"], 2) for r in got if r["id"] % 10 != 9] == [max(round(i % 9 / 10, 2), round(1 - i % 9 / 10, 2)) for i in range(50) if i % 10 != 9]
    assert all(r["error"] == "there is no input" and r["classification"] is None for r in got if r["id"] % 10 == 9)
    assert sum(map(len, seen(tmp_path))) == 45 and len(seen(tmp_path)) == 6  # 22 or 23 of either task, by eight

    held = worker.Resident()
    loads = []
    load = lambda: loads.append(1) or object()
    one = held.get("m", load, 0.2)
    assert held.get("m", load, 0.2) is one and len(loads) == 1
    kept = held.get("always", load, None)
    time.sleep(0.6)
    assert list(held.held) == ["always"] and held.get("always", load, None) is kept
    held.get("m", load, 0.2)
    assert len(loads) == 3
    began = time.monotonic()
    with pytest.raises(TimeoutError):
        worker.within(0.1, time.sleep, 5)
    assert time.monotonic() - began < 2


def test_others_are_stored_before_a_back_off_ends_and_permits_hold(spark, tmp_path):
    c = config.Config.parse(TOML)
    clock = [1000]
    s = open_store(spark, "parquet", str(tmp_path / "store"), now=lambda: clock[0])
    e = classify.Engine(spark, s, c.models(spark), c.pipelines(spark), ("light",))
    e.submit(spark.createDataFrame([("bad", 0, image("http://down/x"), ["general"], None), ("good", 0, image("http://a/x:0.9"), ["general"], None)], ROWS))
    stored = []

    def wait(seconds):
        stored.append({(r["task_id"], r["label"]): r["state"] for r in s.table("model_results").collect()})

    r = Runner(e, c, {"general": lambda: scores, "nsfw": lambda: scores}, download, tool=tool, retries=1, wait=wait)
    r.run()
    assert stored and stored[0]["good", "general"] == "done"
    item = lambda t: s.table("items").where(F.col("task_id") == t).first()
    assert item("bad")["state"] == "failed"
    # two permits, one of them held by an item in back-off; a late one of a high priority overtakes the one that waits
    e.submit(spark.createDataFrame([("holder", 0, image("http://down/y"), ["general"], None)], ROWS))
    r = Runner(e, c, {"general": lambda: scores, "nsfw": lambda: scores}, download, tool=tool, retries=1, slots=2, wait=wait)
    assert r.run(linger=False).count() == 0 and item("holder")["state"] == "retrying" and item("holder")["retry_at"] > clock[0]
    e.submit(spark.createDataFrame([("first", 0, image("http://a/x:0.1"), ["general"], None)], ROWS))
    e.submit(spark.createDataFrame([("late", 0, image("http://a/x:0.2"), ["nsfw"], None)], ROWS))
    assert [tuple(x) for x in r.run(linger=False).collect()] == [("late", 0, "completed")]
    assert item("holder")["state"] == "retrying" and item("first")["state"] == "queued"
    assert [tuple(x) for x in r.run(linger=False).collect()] == [("first", 0, "completed")]
    clock[0] += 60
    assert [tuple(x) for x in r.run(linger=False).collect()] == [("holder", 0, "failed")]


def test_a_stream_of_submissions_ends_in_deliveries(spark, tmp_path):
    from vigilframe.streaming.serve import Service

    c = config.Config.parse(TOML)
    s = open_store(spark, "parquet", str(tmp_path / "store"))
    e = classify.Engine(spark, s, c.models(spark), c.pipelines(spark), ("light",))
    r = Runner(e, c, {"general": lambda: scores, "nsfw": lambda: scores}, download, tool=tool, retries=1)
    (tmp_path / "in").mkdir()
    sent = str(tmp_path / "sent")

    def deliver(row):
        with open(f"{sent}-{row['task_id']}", "w") as f:
            f.write(row["state"])

    stream = spark.readStream.schema(ROWS).parquet(str(tmp_path / "in"))
    service = Service(r, str(tmp_path / "streams"), deliver).start(stream, 0.5)
    try:
        for name, main in (("one", "http://a/x:0.9"), ("two", "http://down/z")):
            spark.createDataFrame([(name, 0, image(main), ["general"], None)], ROWS).write.mode("append").parquet(str(tmp_path / "in"))
        end = time.time() + 150
        while time.time() < end and not service.problem() and not all((tmp_path / f"sent-{n}").exists() for n in ("one", "two")):
            time.sleep(0.5)
    finally:
        service.stop()
    assert service.problem() is None
    assert (tmp_path / "sent-one").read_text() == "completed" and (tmp_path / "sent-two").read_text() == "failed"


def test_uploads_over_several_batches(spark, tmp_path):
    from vigilframe.streaming import upload

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    c = config.Config.parse(TOML)
    s = open_store(spark, "parquet", str(tmp_path / "store"))
    e = classify.Engine(spark, s, c.models(spark), c.pipelines(spark), ("light",))
    (tmp_path / "in").mkdir()
    told, numbers, sent = {}, {}, []
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 10000)

    def send(*messages):
        rows = []
        for name, kind, data in messages:
            numbers[name] = numbers.get(name, -1) + 1
            rows.append((name, numbers[name], kind, False, ["general"] if data != b"-" else [], None, data if kind == "data" else None))
        spark.createDataFrame(rows, upload.MESSAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        sent.append(len(rows))  # the stream never rests, as its timers may fire
        end = time.time() + 60
        while time.time() < end and q.exception() is None and sum(p["numInputRows"] for p in q.recentProgress) < sum(sent):
            time.sleep(0.1)

    stream = spark.readStream.schema(upload.MESSAGES).parquet(str(tmp_path / "in"))
    q = upload.start_uploads(stream, e, str(tmp_path / "staged"), str(tmp_path / "ck"), most_bytes=10, expire_seconds=20, refused=lambda rows: told.update({r["upload_id"]: r["problem"] for r in rows.collect()}), processingTime="100 milliseconds")
    try:
        send(("good", "init", None), ("late", "init", None), ("late", "data", b"abc"), ("bare", "init", b"-"))
        send(("good", "data", b"x:"), ("big", "init", None), ("big", "data", b"123456"), ("headless", "data", b"x"), ("void", "init", None))
        send(("good", "data", b"0.7"), ("big", "data", b"12345"), ("twice", "init", None), ("twice", "init", None), ("void", "end", None))
        send(("good", "end", None), ("big", "end", None), ("headless", "end", None))
        assert (tmp_path / "staged" / "good.bin").read_bytes() == b"x:0.7"
        assert s.table("tasks").select("task_id").collect() == [("good",)]
        want = {"bare": "models or a pipeline are required", "big": "the upload is too large", "headless": "the first message must describe the upload", "twice": "the upload was described twice", "void": "the upload is empty"}
        assert {k: v for k, v in told.items() if k != "late"} == want
        end = time.time() + 60
        while time.time() < end and "late" not in told and q.exception() is None:
            time.sleep(0.3)
        assert q.exception() is None and told == want | {"late": "the upload was not finished in time"}
    finally:
        q.stop()
    assert [p.name for p in (tmp_path / "staged").iterdir()] == ["good.bin"]
    Runner(e, c, {"general": lambda: scores, "nsfw": lambda: scores}, download, tool=tool).run()
    assert s.table("items").first()["state"] == "completed" and not list((tmp_path / "staged").iterdir())


def test_a_delivery_counts_when_its_write_is_committed(spark, tmp_path, monkeypatch):
    """A task that dies in the middle: nothing is marked, and all is delivered at least once."""
    from vigilframe.streaming.deliver import DeliverySink

    folder, log = tmp_path / "got", str(tmp_path / "log")
    folder.mkdir()
    (tmp_path / "where.py").write_text(
        f"import os, uuid\n\ndef deliver(row):\n    if row['task_id'] == 't5' and os.path.exists({str(tmp_path / 'broken')!r}):\n        os._exit(1)\n"
        f"    if row['task_id'] == 't7':\n        raise OSError('refused')\n    open(f\"{folder}/{{row['task_id']}}-{{uuid.uuid4()}}\", 'w').close()\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "where.py"))
    spark.dataSource.register(DeliverySink)
    s = open_store(spark, "parquet", str(tmp_path / "store"))
    s.create_tasks(spark.range(10).select(F.concat(F.lit("t"), "id").alias("task_id"), F.lit(0).cast("long").alias("idx"), F.lit(None).cast("struct<kind:string,main:string,fallback:string,text:string,path:string,video:boolean>").alias("input"), F.array(F.lit("m")).alias("models"), F.lit(None).cast("string").alias("pipeline")))
    s.append("items", spark.range(10).select(F.concat(F.lit("t"), "id").alias("task_id"), F.lit(0).cast("long").alias("idx"), F.lit("completed").alias("state")))
    pending = lambda: s.items_pending_webhook().select("task_id", "idx", "state").repartition(2, "task_id")
    send = lambda: pending().write.format("deliveries").mode("append").options(to="where:deliver", waits="0,0", log=log).save()
    (tmp_path / "broken").touch()
    with pytest.raises(Exception):  # noqa: B017
        send()
    assert s.take_delivered(log) == 0 and pending().count() == 10
    (tmp_path / "broken").unlink()
    send()
    assert s.take_delivered(log) == 9 and [r["task_id"] for r in pending().collect()] == ["t7"] and s.take_delivered(log) == 0
    assert {p.name.split("-")[0] for p in folder.iterdir()} == {f"t{i}" for i in range(10) if i != 7}
    # a stream into the same sink
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("t7x", 3, "failed")], "task_id string, idx bigint, state string").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("task_id string, idx bigint, state string").parquet(str(tmp_path / "in"))
    q = stream.writeStream.format("deliveries").options(to="where:deliver", waits="0", log=log).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(60) and q.exception() is None
    assert [p.read_text() for p in (tmp_path / "log").glob("batch-*.json")] == ['{"task_id": "t7x", "idx": 3}\n']


def test_posts_are_signed(spark):
    import http.server
    import threading

    from vigilframe.streaming import deliver, scan

    got = []

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            got.append((self.headers["X-Signature"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(500 if "bad" in self.path else 204)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_address[1]}"
        deliver.post({"task_id": "t", "idx": 0, "state": "completed"}, f"{url}/hook", "key")
        with pytest.raises(OSError):
            deliver.post({"task_id": "t", "idx": 0, "state": "completed"}, f"{url}/bad")
    finally:
        server.shutdown()
    assert got[0][1] == {"task_id": "t", "idx": 0, "state": "completed"} and got[1][0] is None
    received = spark.createDataFrame([("t", got[0][0]), ("u", got[0][0])], "task_id string, signature string")
    assert [r["problem"] for r in scan.verified(received, "key").orderBy("task_id").collect()] == [None, "invalid signature"]
