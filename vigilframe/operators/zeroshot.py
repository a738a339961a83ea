"""Zero-shot scores of embeddings against prompts, softmax, and their flat and taxonomy classifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import f32
from ..functions.heads import TOP
from .select import flat_top

#: Bytes of prompt vectors that are broadcast at most, and of one block of them beyond that.
PROMPT_BYTES = 32 << 20
#: Images of one matrix product.
IMAGE_ROWS = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """x / |x| in DOUBLE; a zero vector has no direction: null components instead of NaN."""
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), l2_norm(v)))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def sigmoid_score(cos: Column, log_scale: float, bias: float) -> Column:
    """1 / (1 + exp(-(exp(log_scale) * cos + bias)))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.exp(F.lit(log_scale)) * cos + F.lit(bias))))


def prompt_text(label: Column, template: str | None) -> Column:
    """All `{}` of the template replaced, else the template as a prefix, else the label itself."""
    if template is None:
        return label
    if "{}" in template:
        return F.replace(F.lit(template), F.lit("{}"), label)
    return F.concat(F.lit(template + " "), label)


def prompt_tokens(load, length: int = 64):
    """A Spark function of prompts: token ids of exactly `length` places, longer ones cut, shorter ones padded.

    `load()` gives a tokenizer of the `tokenizers` package and runs once a batch of rows; its own rules say
    which special tokens stay when a prompt is cut. A length of 0 is the usual 64. Null prompts have no ids.
    """
    import pandas as pd

    places = length or 64

    def ids(prompts):  # pragma: no cover - runs in workers
        tokenizer = load()
        tokenizer.enable_truncation(places)
        tokenizer.enable_padding(length=places)
        found = iter(tokenizer.encode_batch([p for p in prompts if p is not None]))
        return pd.Series([None if p is None else next(found).ids for p in prompts], index=prompts.index, dtype=object)

    ids.__annotations__ = {"prompts": pd.Series, "return": pd.Series}
    return F.pandas_udf(ids, "array<int>")


def softmax(scores: DataFrame, keys: list[str], logit: str = "logit", score: str = "score") -> DataFrame:
    """Add the softmax of `logit` within each group; shifted by the maximum. One shuffle for both windows."""
    w = Window.partitionBy(*keys)
    shifted = scores.withColumn("_e", F.exp(F.col(logit) - F.max(logit).over(w)))
    return shifted.withColumn(score, (F.col("_e") / F.sum("_e").over(w)).cast("float")).drop("_e")


def _matrix(column, width: int):
    """Rows of a list column as a matrix in double precision; all of one length, without nulls inside."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * width:
        raise ValueError(f"vectors must have {width} components")
    return flat.reshape(len(column), width)


class _Block:
    """Some prompts: their vectors and what is read off their scores. Travels to workers as it is."""

    def __init__(self, rows, mode: str, log_scale: float, bias: float, least: float | None, most: int | None):
        from ..functions import heads

        rows = sorted(rows, key=lambda r: r[0])
        self.mode, self.log_scale, self.bias, self.least, self.most = mode, log_scale, bias, least, most
        self.width = len(rows[0][3])
        import numpy as np

        vectors = np.array([r[3] for r in rows], np.float64)
        if mode != "softmax":
            vectors = heads.unit(vectors)
            there = ~np.isnan(vectors).any(axis=1)  # a prompt without a direction scores nothing
            rows, vectors = [r for r, ok in zip(rows, there) if ok], vectors[there]
        self.vectors = np.ascontiguousarray(vectors.T)
        if mode == "taxonomy":
            self.children = heads.Children([(ix, child, how) for ix, child, how, _ in rows])
            self.labels, self.ordinals = self.children.ids, self.children.first
        else:
            self.labels = np.array([child for _, child, _, _ in rows], np.int64)
            self.ordinals = np.array([ix for ix, _, _, _ in rows], np.int64)

    def __call__(self, vectors):
        """(row, label, ordinal, score, maximum, sum of exponentials) of what a matrix of images keeps, flat arrays.

        Without the softmax the last two are zero. With it the score is a logit.
        """
        import numpy as np

        from ..functions import heads

        top, total = np.zeros(len(vectors)), np.zeros(len(vectors))
        if not len(self.labels) or not len(vectors):
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(0), np.zeros(0), np.zeros(0)
        if self.mode == "softmax":
            scores = self.log_scale * (vectors @ self.vectors)
            top = scores.max(axis=1)
            total = np.exp(scores - top[:, None]).sum(axis=1)
            rows, columns, _ = heads.ranked(scores, heads.TOP)  # more than 0.90 has one label at most
        else:
            scores = heads.sigmoid(heads.unit(vectors) @ self.vectors, self.log_scale, self.bias)
            scores = self.children(scores) if self.mode == "taxonomy" else scores.astype(np.float32)
            rows, columns, _ = heads.ranked(scores, self.most, self.least)
            there = ~np.isnan(scores[rows, columns])
            rows, columns = rows[there], columns[there]
        return rows, self.labels[columns], self.ordinals[columns], scores[rows, columns].astype(np.float64), top[rows], total[rows]


def classify_vectors(images: DataFrame, prompts: DataFrame, key: str, mode: str = "flat", log_scale: float = 0.0, bias: float = 0.0, least: float | None = None, most: int | None = None, image_vec: str = "embedding") -> DataFrame:
    """(key, label, ordinal, score FLOAT): what every image (key, vector) keeps of its scores against all prompts.

    `prompts` is (prompt_ix, child_id, agg, prompt_embedding). `flat`: sigmoid(exp(log_scale) * cosine +
    bias) of each prompt, at least `least`, the `most` highest; `taxonomy`: the same pooled by child,
    at least `least`; `softmax`: of log_scale * product, the five highest of an image.

    Scores are blocks of a matrix product in Arrow batches and only what is kept becomes rows. Prompts are
    configuration: their bytes are counted, and up to PROMPT_BYTES go to every worker, so the images
    are read once and not shuffled. More of them are dealt into such blocks by child, packed where they
    lie, and each block meets the images in groups of their own; what the blocks keep is merged by key.

    Vectors without a direction, null ones and those of null keys keep nothing. Keys must differ.
    """
    import pyarrow as pa

    spark = images.sparkSession
    rows = prompts.select("prompt_ix", "child_id", "agg", "prompt_embedding").where("prompt_embedding is not null and prompt_ix is not null")
    size = 8 * (rows.agg(F.sum(F.size("prompt_embedding") + 8)).first()[0] or 0)
    blocks = max(1, -(-size // PROMPT_BYTES))
    kind = images.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, label long, ordinal long, score double, top double, total double, part int"
    given = images.where(F.col(key).isNotNull() & F.col(image_vec).isNotNull() & ~F.exists(F.col(image_vec), lambda x: x.isNull())).select(key, image_vec)

    def scored(block: _Block, keys: pa.Array, vectors: pa.Array, part: int = 0) -> pa.RecordBatch:
        row, *values = block(_matrix(vectors, block.width))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(row)), *map(pa.array, values), pa.array([part] * len(row), pa.int32())], [key, "label", "ordinal", "score", "top", "total", "part"])

    if blocks == 1:
        few = [tuple(r) for r in rows.collect()]
        if not few:
            return spark.createDataFrame([], f"`{key}` {kind}, label long, ordinal long, score float")
        sent = spark.sparkContext.broadcast(_Block(few, mode, log_scale, bias, least, most))

        def run(batches):
            for batch in batches:
                for at in range(0, len(batch), IMAGE_ROWS):
                    part = batch.slice(at, IMAGE_ROWS)
                    yield scored(sent.value, part.column(0), part.column(1))

        found = given.mapInArrow(run, schema)
    else:
        salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)
        number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = given.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")).withColumn("_block", number(blocks))
        right = rows.withColumn("_block", F.pmod(F.xxhash64("child_id" if mode == "taxonomy" else "prompt_ix"), F.lit(blocks)).cast("int")).withColumn("_salt", number(salts))

        def meet(mine: pa.Table, block: pa.Table) -> pa.Table:
            if not len(mine) or not len(block):
                return pa.Table.from_batches([], pa.schema([(key, mine.schema.field(key).type), ("label", pa.int64()), ("ordinal", pa.int64()), *((c, pa.float64()) for c in ("score", "top", "total")), ("part", pa.int32())]))
            held = _Block(list(zip(*(block.column(c).to_pylist() for c in ("prompt_ix", "child_id", "agg", "prompt_embedding")))), mode, log_scale, bias, least, most)
            mine = mine.combine_chunks()
            parts = [mine.slice(at, IMAGE_ROWS).to_batches()[0] for at in range(0, len(mine), IMAGE_ROWS)]
            return pa.Table.from_batches([scored(held, p.column(p.schema.get_field_index(key)), p.column(p.schema.get_field_index(image_vec)), block.column("_block")[0].as_py()) for p in parts])

        found = left.groupBy("_block", "_salt").cogroup(right.groupBy("_block", "_salt")).applyInArrow(meet, schema)
    if mode == "softmax":
        # per block the maximum and the sum of exponentials are enough to put the sums together
        if blocks > 1:
            each = found.groupBy(key, "part", "top", "total").agg(F.collect_list(F.struct("label", "ordinal", "score")).alias("x")).groupBy(key).agg(F.collect_list(F.struct("top", "total", "x")).alias("b"))
            peak = F.array_max(F.transform("b", lambda b: b["top"]))
            whole = F.aggregate("b", F.lit(0.0), lambda a, b: a + b["total"] * F.exp(b["top"] - F.col("peak")))
            found = each.withColumn("peak", peak).select(key, F.col("peak").alias("top"), whole.alias("total"), F.explode(F.flatten(F.transform("b", lambda b: b["x"]))).alias("y")).select(key, "y.*", "top", "total")
            best = Window.partitionBy(key).orderBy(F.desc("score"), "ordinal")
            found = found.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= TOP).drop("_rank")
        return found.select(key, "label", "ordinal", (F.exp(F.col("score") - F.col("top")) / F.col("total")).cast("float").alias("score"))
    found = found.select(key, "label", "ordinal", F.col("score").cast("float").alias("score"))
    if blocks > 1 and most is not None:
        found = flat_top(found, [key], least if least is not None else float("-inf"), most).drop("rank")
    return found


def taxonomy_scores(scored: DataFrame, key: str, threshold: float = 0.0) -> DataFrame:
    """(key, child_id, parent_id, ordinal, score): per child the mean or maximum over its own prompts.

    `scored` has child_id, parent_id, prompt_ix and agg ("mean", "average" or "max"; null is max).
    Children keep the order of their first prompt; scores of at least `threshold` stay.
    """
    pooled = scored.groupBy(key, "child_id", "parent_id").agg(
        F.min("prompt_ix").alias("ordinal"),
        F.when(F.first("agg").isin("mean", "average"), F.avg("score")).otherwise(F.max("score")).cast("float").alias("score"),
    )
    return pooled.where(F.col("score") >= f32(threshold))
