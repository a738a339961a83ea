"""Submissions and task states: validation, admission, roll-up, retention, recovery, delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.durable import durable
from ..functions.exprs import is_terminal, modality, model_done

#: A task that is resumed more often than this is failed.
RESUMES = 3
ACTIVE = ("queued", "processing")


def submissions(requests: DataFrame) -> DataFrame:
    """Add `problem` to requests without an input, or with neither models nor a pipeline."""
    problem = F.when(F.col("kind").isNull(), "an input is required").when((F.size(F.coalesce("models", F.array().cast("array<string>"))) == 0) & (F.coalesce("pipeline", F.lit("")) == ""), "models or a pipeline are required")
    return requests.withColumn("problem", problem)


def validate_items(items: DataFrame, models: DataFrame, strategies: list[str]) -> DataFrame:
    """(item, problem): the first rule broken, in rule order and then in the order of the item's models.

    Rules: no models; text or audio input; then per model: unknown, disabled, and for videos a known
    strategy. `models` (model, enabled, strategy) is configuration; Spark broadcasts it if it is small.
    """
    kind = modality(F.col("kind"), F.col("video"))
    base = items.select("item", kind.alias("modality"), F.coalesce("models", F.array().cast("array<string>")).alias("models"))
    each = base.select("item", "modality", F.posexplode("models").alias("pos", "model")).join(models.select("model", "enabled", "strategy"), "model", "left")
    rule = (
        F.when(F.col("enabled").isNull(), F.concat(F.lit("unknown model: "), "model"))
        .when(~F.col("enabled"), F.concat(F.lit("model is disabled: "), "model"))
        .when((F.col("modality") == "video") & ~F.coalesce(F.col("strategy").isin(*strategies), F.lit(False)), F.concat(F.lit("model has no known strategy: "), "model"))
        .when(F.col("modality").isin("text", "audio"), F.concat(F.col("modality"), F.lit(" input is not supported")))
    )
    broken = each.withColumn("problem", rule).where("problem is not null").groupBy("item").agg(F.min_by("problem", "pos").alias("problem"))
    empty = F.when(F.size("models") == 0, F.lit("no models requested"))
    return base.join(broken, "item", "left").select("item", F.coalesce(empty, "problem").alias("problem"))


def item_priorities(items: DataFrame, models: DataFrame) -> DataFrame:
    """(item, priority): the highest priority of an item's known models, 0 without one."""
    each = items.select("item", F.explode_outer("models").alias("model")).join(models.select("model", "priority"), "model", "left")
    return each.groupBy("item").agg(F.coalesce(F.max("priority"), F.lit(0)).alias("priority"))


#: Ranges of arrival numbers that a gate's waiters are numbered in.
RANGES = 4096


def waiting_order(waiters: DataFrame, groups: list[str], priority: str = "priority", seq: str = "seq") -> DataFrame:
    """Number those that wait: higher priority first, then arrival (a whole number). `groups` are the gates.

    A gate may hold a large share of all rows, so places are counted in two levels: within ranges of
    arrival numbers, and over the ranges' pre-aggregated counts.
    """
    lo, hi = waiters.agg(F.min(seq), F.max(seq)).first()
    width = max(1, -(-(hi - lo + 1) // RANGES)) if lo is not None else 1
    keyed = waiters.withColumn("_range", F.floor((F.col(seq) - F.lit(lo or 0)) / width))
    keys = [*groups, priority, "_range"]
    counts = keyed.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy(F.desc(priority), F.asc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"_of_{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(seq))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{i}")) for i, k in enumerate(keys)]
    joined = keyed.withColumn("_own", own).join(counts, same)
    return joined.withColumn("place", (F.col("_before") + F.col("_own")).cast("int")).select(*waiters.columns, "place")


def admitted(waiters: DataFrame, groups: list[str], slots: int, **names) -> DataFrame:
    return waiting_order(waiters, groups, **names).where(F.col("place") <= slots)


#: Bytes of step functions that come to the driver at most (see within_capacity).
STEP_BYTES = 64 << 20


def within_capacity(batch: DataFrame, pending_now: int, most: int, groups: list[str], order: str = "seq", items: str = "n_items", parts: int | None = None) -> DataFrame:
    """Add `accepted`: whether the queue would still hold a submission; a maximum of 0 accepts all.

    Submissions of a group arrive one after the other and only accepted ones count, so that a refused
    large one leaves room for later small ones.

    No group is gathered. Rows are sorted into ranges of (group, arrival). A range tells of its first
    group a step function, the room left behind it for each room before it, and of its last group what
    is left if it begins there: the others lie inside. Functions of neighbouring ranges compose, so a
    fold over one function a range, `most` + 1 numbers, gives every range the room it begins with, and
    it then decides its own rows. Sizes that are null or negative count as 0.
    """
    if most <= 0:
        return batch.withColumn("accepted", F.lit(True))
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    spark = batch.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(parts, STEP_BYTES // (4 * (most + 1))))
    free = most - pending_now
    columns = batch.columns
    numbered = batch.withColumn("__group", F.to_json(F.struct(*groups))).withColumn("__n", F.greatest(F.coalesce(F.col(items), F.lit(0)), F.lit(0)).cast("long"))
    ranged = durable(numbered.repartitionByRange(parts, "__group", order).sortWithinPartitions("__group", order, "__n"))

    def begun(batches):
        """(batch, per row whether a group other than the row's before begins with it, sizes), in order."""
        before = None
        for rows in batches:
            if not rows.num_rows:
                continue
            names = rows.column("__group")
            new = np.ones(rows.num_rows, bool)
            new[1:] = pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)
            new[0] = names[0].as_py() != before
            before = names[-1].as_py()
            yield rows, new, rows.column("__n").to_numpy()

    def tell(batches):
        first = last = steps = None
        room, inside = free, True
        for rows, new, sizes in begun(batches):
            names = rows.column("__group")
            if first is None:
                first, steps = names[0].as_py(), np.arange(most + 1, dtype=np.int32)
                new[0] = False
            at = 0
            if inside:  # rows of the first group; those that no queue can take change nothing
                at = int(new.argmax()) if new.any() else len(new)
                inside = at == len(new)
                mine = sizes[:at]
                for n in mine[(mine > 0) & (mine <= most)].tolist():
                    steps = np.where(steps >= n, steps - n, steps).astype(np.int32)
            for n, begins in zip(sizes[at:].tolist(), new[at:].tolist()):
                if begins:
                    room = free
                if n <= room:
                    room -= n
            last = names[-1].as_py()
        if first is not None:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "first": first, "last": last, "steps": steps.tobytes(), "room": room}], pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("steps", pa.binary()), ("room", pa.int64())]))

    told = sorted(ranged.select("__group", "__n").mapInArrow(tell, "part int, first string, last string, steps binary, room long").collect())
    starts, before, room = {}, None, free
    for part, first, last, steps, left in told:
        starts[part] = room if first == before else free
        room = left if last != first else starts[part] if starts[part] < 0 else int(np.frombuffer(steps, np.int32)[starts[part]])
        before = last

    def decide(batches):
        room, started = free, False
        for rows, new, sizes in begun(batches):
            if not started:
                room, started = starts[TaskContext.get().partitionId()], True
                new[0] = False
            fits = []
            for n, begins in zip(sizes.tolist(), new.tolist()):
                if begins:
                    room = free
                fits.append(n <= room)
                room -= n if fits[-1] else 0
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), pa.array(fits, pa.bool_())], names=[*columns, "accepted"])

    return ranged.mapInArrow(decide, T.StructType([*batch.schema.fields, T.StructField("accepted", T.BooleanType())]))


def admit_in_order(batch: DataFrame, pending_now: int, most: int, order: str, items: str) -> DataFrame:
    """The rows that a queue of `most` items still takes, in order of arrival; a maximum of 0 takes all.

    No more rows than there are free places can be taken, so the first of them by arrival are looked at,
    as long as places are left: each round takes what fits up to the first row that does not, and goes
    on behind it with the rows that would fit into the rest.
    """
    if most <= 0:
        return batch
    free, taken, rest = most - pending_now, None, batch.where((F.col(items) <= most) & (F.col(items) > 0))
    out = batch.where(F.col(items) <= 0)
    while free > 0:
        first = [(r[0], r[1]) for r in rest.where(F.col(items) <= free).orderBy(order).select(order, items).limit(free).collect()]  # at most `most` short rows
        took = []
        for key, n in first:
            if n <= free:
                took.append(key)
                free -= n
        if not took:
            break
        taken = rest.where(F.col(order).isin(*took)) if taken is None else taken.unionByName(rest.where(F.col(order).isin(*took)))
        rest = rest.where(F.col(order) > F.lit(first[-1][0]))
    return out if taken is None else out.unionByName(taken)


def running_cap(chunks: DataFrame, keys: list[str], order: str, size: Column, most: int) -> DataFrame:
    """Add `received` (bytes so far) and `within`: whether an upload is still inside its cap."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("received", F.sum(size).over(w)).withColumn("within", F.col("received") <= most)


def task_states(items: DataFrame, task: str = "task_id", state: str = "state") -> DataFrame:
    """(task, state): completed once all items are terminal, else processing; never failed."""
    return items.groupBy(task).agg(F.when(F.bool_and(is_terminal(F.col(state))), "completed").otherwise("processing").alias(state))


def roll_up(tasks: DataFrame, items: DataFrame) -> DataFrame:
    """Task states after their items': terminal tasks never change; a task without items is completed."""
    now = task_states(items).withColumnRenamed("state", "_rolled")
    joined = tasks.join(now, "task_id", "left")
    return joined.withColumn("state", F.when(is_terminal(F.col("state")), F.col("state")).otherwise(F.coalesce("_rolled", F.lit("completed")))).drop("_rolled")


def result_overlay(requested: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Requested results with their stored state, queued without one; stored results outside the request stay."""
    return requested.select(*keys).distinct().join(stored, keys, "full_outer").withColumn("state", F.coalesce("state", F.lit("queued")))


def item_finished(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, finished): whether all models of an item are done or skipped."""
    return results.groupBy(*keys).agg(F.bool_and(model_done(F.col("state"))).alias("finished"))


def incomplete(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("state").isin(*ACTIVE)).orderBy("created_at")


def pending_deliveries(items: DataFrame) -> DataFrame:
    return items.where(~F.coalesce(F.col("webhook_delivered"), F.lit(False)) & is_terminal(F.col("state")))


def expired(tasks: DataFrame, cutoff: int) -> DataFrame:
    """Finished tasks last touched before the cutoff (strictly)."""
    return tasks.where(is_terminal(F.col("state")) & (F.col("updated_at") < cutoff))


def purge(tasks: DataFrame, children: dict[str, DataFrame], cutoff: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Tasks and their rows in all child tables without the expired ones."""
    gone = expired(tasks, cutoff).select("task_id")
    return tasks.join(gone, "task_id", "left_anti"), {n: c.join(gone, "task_id", "left_anti") for n, c in children.items()}


def recover(tasks: DataFrame) -> DataFrame:
    """Interrupted tasks with attempts raised and `action`: fail beyond RESUMES, else requeue."""
    raised = incomplete(tasks).withColumn("attempts", F.col("attempts") + 1)
    return raised.withColumn("action", F.when(F.col("attempts") > RESUMES, "fail").otherwise("requeue"))


def orphaned_uploads(listing: DataFrame, inputs: DataFrame) -> DataFrame:
    """Staged files that no incomplete task refers to."""
    return listing.join(inputs.select("path").where("path is not null").distinct(), "path", "left_anti")


def after_failure(items: DataFrame, limit: int) -> DataFrame:
    """Items whose fetch or step failed: retrying with a raised count and a delay, or failed when out of retries."""
    from ..functions.exprs import retry_backoff

    again = F.col("retries") < limit
    return items.withColumns({"state": F.when(again, "retrying").otherwise("failed"), "retries": F.col("retries") + again.cast("int"), "delay": F.when(again, retry_backoff(F.col("retries") + 1))})


def close_models(results: DataFrame, item_state: Column) -> DataFrame:
    """Models of a failed item that are not done become failed."""
    return results.withColumn("state", F.when((item_state == "failed") & ~model_done(F.col("state")), "failed").otherwise(F.col("state")))
