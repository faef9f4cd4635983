"""Model training and scoring on the cleaned table with ``pyspark.ml``.

Design notes for scale:

* Label encoding (M3) does not use ``StringIndexer``: fitting it collects
  every distinct label to the driver.  Codes are the position of a value in
  the sorted distinct values, computed for all text columns at once by one
  range-partitioned row index; dictionaries of checked size are looked up in
  the tasks, larger ones are joined: frequent values column by column against
  a bounded broadcast, all other values of all columns at once.
* A forest draws the counts of each row anew for every level of its trees
  (`forest.py`), from rows written once in compressed blocks that are dealt
  into partitions of bounded size.
* Ridge (M7) is solved from sums of products (`linear.py`).
* The 80/20 split (M5) is a hash of the row content and a seed: stable
  across recomputation and executor loss, no sampling state.
* Standardisation (M6) is one aggregate on the training rows and a
  projection; metrics (M12) are one aggregate over the predictions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.numeric import DATE_TYPES, numeric_columns, q
from tabulon.functions.roles import detect_target
from tabulon.operators.distinct import few_values
from tabulon.operators.forest import RandomForestRegressor
from tabulon.operators.linear import fit_ridge
from tabulon.operators.ordering import row_index
from tabulon.session import materialize, shuffles_freed

SEED = 42
MIN_ROWS = 20
FEATURES = "__features"
LABEL = "__label"


def detect_problem_type(df: DataFrame, target: str, types: dict[str, str]) -> str:
    """M2: classification for categorical/binary targets or at most 10 distinct values."""
    if types.get(target) in ("categorical", "binary"):
        return "classification"
    return "classification" if few_values(df, [target], 10)[target] else "regression"


def choose_target(df: DataFrame) -> str | None:
    """M1: first column named like a target, else the last numeric column."""
    return detect_target(df.columns, numeric_columns(df))


#: A task sorts, groups or pivots about this many rows.
ROWS_A_TASK = 500_000
#: Bytes of a partition of a forest's rows, with their counts.
FOREST_BYTES = 256 << 20
#: Rows of a compressed block of a written table, and of a piece of it that is handed on.
BLOCK_ROWS, PIECE_ROWS = 1 << 15, 1 << 13
#: A value in more rows than this is met with its code without a shuffle; there are at most HOT_VALUES of them, of HOT_CHARS characters.
HOT_ROWS, HOT_VALUES, HOT_CHARS = 100_000, 4096, 1024


def spread(df: DataFrame, rows: int = ROWS_A_TASK) -> DataFrame:
    """The rows dealt into partitions of about `rows`; as they are where no partition holds more."""
    n = _parts(df, rows)
    return df.repartition(n) if n else df


def _parts(df: DataFrame, rows: int) -> int:
    """How many partitions of about `rows` the rows make; 0 where no partition holds more."""
    held = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("part")).count().collect()]  # a number a partition
    return -(-sum(held) // rows) if max(held, default=0) > rows else 0


def written(df: DataFrame, rows: int) -> DataFrame:
    """The rows written once for many reads, in the same order each time, as compressed Arrow blocks.

    Partitions stay as they are; where one holds more than `rows`, whole blocks are dealt into partitions of about `rows`,
    so no loose row is shuffled.
    """
    n, size, schema = _parts(df, rows), min(BLOCK_ROWS, rows), df.schema

    def block(held):
        out, table = pa.BufferOutputStream(), pa.Table.from_batches(held).combine_chunks()
        with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
            to.write_table(table)
        return pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["block"])

    def pack(batches):
        held, many = [], 0
        for b in batches:
            while many + b.num_rows >= size:
                yield block([*held, b.slice(0, size - many)])
                b, held, many = b.slice(size - many), [], 0
            held, many = [*held, b], many + b.num_rows
        if many:
            yield block(held)

    def unpack(batches):
        for b in batches:
            for one in b.column(0):
                for piece in pa.ipc.open_stream(one.as_buffer()):
                    for at in range(0, piece.num_rows, PIECE_ROWS):
                        yield piece.slice(at, PIECE_ROWS)

    blocks = df.mapInArrow(pack, "block binary")
    with shuffles_freed(df.sparkSession):
        held = materialize(blocks.repartition(n) if n else blocks)
    return held.mapInArrow(unpack, schema)


def forest_rows(trees: int, features: int) -> int:
    """Rows a partition of a forest's input: each has a count for every tree and a bin for every feature."""
    return max(1, FOREST_BYTES // (4 * trees + 8 * features + 200))


#: Columns with at most this many labels and characters of labels are looked up in a dictionary that every task holds.
DICTIONARY_ROWS, DICTIONARY_CHARS = 200_000, 16 << 20


def label_encode(df: DataFrame, cols: list[str], dictionary_rows: int = DICTIONARY_ROWS) -> tuple[DataFrame, dict[str, DataFrame]]:
    """M3: replace each text column by the 0-based rank of its value among the sorted distinct values.

    Distinct ``(column, value)`` pairs of all columns are unpivoted and numbered by one range-partitioned row index; a
    column's codes are its indexes minus the index of its first value.  Columns whose dictionaries are small by count
    (checked before anything is collected) are encoded together by one lookup in the tasks, without a shuffle.  All
    others are met with the codes by joins: frequent values, of which there is a bounded number, with a broadcast for each
    column, the rest together, unpivoted with the row they stand in and put back by row.  Returns the encoded frame and, per column, ``(value, code)``.
    """
    if not cols:
        return df, {}
    arms = [F.struct(F.lit(c).alias("__col"), q(c).cast("string").alias("__v")) for c in cols]
    pairs = df.select(F.inline(F.array(*arms))).where(F.col("__v").isNotNull()).groupBy("__col", "__v").agg(F.count(F.lit(1)).alias("__n"))
    idx = materialize(row_index(pairs, ["__col", "__v"], name="__g"))
    sizes = {r["__col"]: r for r in idx.groupBy("__col").agg(F.min("__g").alias("first"), F.count(F.lit(1)).alias("n"),
                                                            F.sum(F.length("__v")).alias("chars")).collect()}
    first = F.create_map(*[F.lit(x) for c in cols for x in (c, int(sizes[c]["first"]) if c in sizes else 0)])
    codes = idx.select("__col", "__v", "__n", (F.col("__g") - first[F.col("__col")]).alias("__code"))
    tables = {c: codes.where(F.col("__col") == c).select(F.col("__v").alias("value"), F.col("__code").alias("code")) for c in cols}
    small, rows, chars = [], 0, 0
    for c in sorted(cols, key=lambda c: sizes[c]["n"] if c in sizes else 0):
        n, m = (sizes[c]["n"], sizes[c]["chars"]) if c in sizes else (0, 0)
        if rows + n <= dictionary_rows and chars + m <= DICTIONARY_CHARS:
            small, rows, chars = [*small, c], rows + n, chars + m
    out = _looked_up(df, codes, small) if small else df
    large = [c for c in cols if c not in small]
    return (_met_with_codes(out, codes, large) if large else out), tables


def _looked_up(df: DataFrame, codes: DataFrame, cols: list[str]) -> DataFrame:
    """Codes from sorted dictionaries: the position of a value is its code."""
    labels: dict[str, list[str]] = {c: [] for c in cols}
    for r in codes.where(F.col("__col").isin(cols)).orderBy("__col", "__code").collect():  # size checked by the caller
        labels[r["__col"]].append(r["__v"])
    held = df.sparkSession.sparkContext.broadcast(labels)
    at = {df.columns.index(c): c for c in cols}
    schema = T.StructType([T.StructField(f.name, T.DoubleType() if f.name in labels else f.dataType) for f in df.schema.fields])

    def run(batches):
        sets = {i: pa.array(held.value[c], pa.string()) for i, c in at.items()}
        for b in batches:
            arrays = [pc.index_in(a.cast(pa.string()), value_set=sets[i]).cast(pa.float64()) if i in sets else a for i, a in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(*[(q(c).cast("string") if c in labels else q(c)).alias(c) for c in df.columns]).mapInArrow(run, schema)


def _met_with_codes(df: DataFrame, codes: DataFrame, cols: list[str]) -> DataFrame:
    """Codes by joins.  No shuffle for frequent values; two for all others, whatever the number of columns."""
    codes = codes.where(F.col("__col").isin(cols))
    total = codes.agg(F.sum("__n").alias("n")).first()["n"] or 0
    hot = (F.col("__n") > max(HOT_ROWS, total // HOT_VALUES)) & (F.length("__v") <= HOT_CHARS)
    found = {r["__col"]: r for r in codes.groupBy("__col").agg(F.count_if(hot).alias("hot"), F.sum(F.when(~hot, F.col("__n"))).alias("cold")).collect()}
    out, code, arms = spread(df), {}, []
    for i, c in enumerate(cols):
        value, code[c] = q(c).cast("string"), F.lit(None).cast("long")
        if c in found and found[c]["hot"]:
            few = codes.where(hot & (F.col("__col") == c)).select(F.col("__v").alias(f"__v{i}"), F.col("__code").alias(f"__h{i}"))
            out = out.join(F.broadcast(few), value == F.col(f"__v{i}"), "left").drop(f"__v{i}")
            code[c] = F.col(f"__h{i}")
        if c in found and found[c]["cold"]:
            arms.append(F.struct(F.lit(c).alias("__col"), F.when(code[c].isNull(), value).alias("__v")))
    if arms:
        base = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = materialize(out.select("*", F.monotonically_increasing_id().alias("__row")))  # written, so that ids stay
        cells, lines = max(base, -(-sum(r["cold"] or 0 for r in found.values()) // ROWS_A_TASK)), max(base, -(-rows.count() // ROWS_A_TASK))
        met = (rows.select("__row", F.inline(F.array(*arms))).where(F.col("__v").isNotNull()).repartition(cells, "__col", "__v")
               .join(codes.where(~hot).select("__col", "__v", "__code"), ["__col", "__v"])
               .select("__row", "__col", "__code").repartition(lines, "__row")
               .groupBy("__row").agg(*[F.max(F.when(F.col("__col") == c, F.col("__code"))).alias(f"__c{i}") for i, c in enumerate(cols)]))
        out = rows.repartition(lines, "__row").join(met, "__row", "left")
        code = {c: F.coalesce(x, F.col(f"__c{i}")) for i, (c, x) in enumerate(code.items())}
    return out.select(*[code[c].cast("double").alias(c) if c in cols else q(c) for c in df.columns])


def split(df: DataFrame, train_pct: int = 80, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """M5: stable hash split of whole rows (not the reference's rows)."""
    h = F.pmod(F.xxhash64(F.lit(seed), *[q(c) for c in df.columns]), F.lit(100))
    return df.where(h < train_pct), df.where(h >= train_pct)


def standardize(train: DataFrame, test: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """M6: (x - mean) / population std, fitted on train; a zero std scales by 1."""
    row = train.agg(*[x for i, c in enumerate(cols)
                      for x in (F.avg(q(c)).alias(f"m{i}"), F.stddev_pop(q(c)).alias(f"s{i}"))]).first()

    def apply(df):
        exprs = []
        for f in df.schema.fields:
            if f.name in cols:
                i = cols.index(f.name)
                m, s = row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0
                exprs.append(((q(f.name) - F.lit(m)) / F.lit(s if s > 0 else 1.0)).alias(f.name))
            else:
                exprs.append(q(f.name))
        return df.select(*exprs)
    return apply(train), apply(test)


def regression_metrics(pred: DataFrame, label: str = LABEL, prediction: str = "prediction") -> dict[str, float]:
    """R2, RMSE and MAE (4 dp) in one aggregate."""
    y, p = F.col(label), F.col(prediction)
    r = pred.agg(F.sum((y - p) ** 2).alias("sse"), F.count(F.lit(1)).alias("n"), F.avg(y).alias("ybar"),
                 F.sum(F.abs(y - p)).alias("sae"), F.var_pop(y).alias("vy")).first()
    n = r["n"] or 0
    if n == 0:
        return {"R2": float("nan"), "RMSE": float("nan"), "MAE": float("nan")}
    sst = (r["vy"] or 0.0) * n
    r2 = 1 - r["sse"] / sst if sst > 0 else float("nan")
    return {"R2": round(r2, 4), "RMSE": round(math.sqrt(r["sse"] / n), 4), "MAE": round(r["sae"] / n, 4)}


def accuracy(pred: DataFrame, label: str = LABEL, prediction: str = "prediction") -> float:
    r = pred.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("a")).first()
    return round(r["a"], 4) if r["a"] is not None else float("nan")


@dataclass
class MLResult:
    problem_type: str
    target: str
    features: list[str]
    scores: DataFrame                       # (model, metric, value)
    best_model: str | None
    best_metrics: dict[str, float]
    importances: DataFrame                  # (feature, importance), top 10
    predictions: DataFrame                  # (index, actual, predicted), first 100 test rows
    errors: dict[str, str] = field(default_factory=dict)


_SCORE_SCHEMA = "model string, metric string, value double"


def auto_ml(df: DataFrame, target: str, problem: str | None = None, types: dict[str, str] | None = None,
            order_by: list[str] | None = None, boosted: bool = False, num_trees: int = 100,
            alpha: float = 1.0) -> MLResult:
    """Encode, split, train Ridge/forest(/boosted) and score; the best model wins.

    ``order_by`` orders the test rows for the actual-vs-predicted sample;
    by default every remaining column is used.
    """
    spark = df.sparkSession
    types = types or {}
    problem = problem or detect_problem_type(df, target, types)
    data = df.na.drop()
    text = [f.name for f in data.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType, *DATE_TYPES)) and f.name != target]
    target_codes = None
    if problem == "classification":
        data, tabs = label_encode(data, text + [target])
        target_codes = tabs[target]
    else:
        data, _ = label_encode(data, text)
    feats = [c for c in numeric_columns(data) if c != target]
    data = data.select(*[q(c).cast("double").alias(c) for c in feats], q(target).cast("double").alias(LABEL))
    # Encoded once, read by every model fit and score: cut the lineage here.
    data = written(data, forest_rows(num_trees, len(df.columns)))
    n = data.count()
    if n < MIN_ROWS or not feats:
        raise ValueError("Not enough data for ML")
    train, test = split(data)
    assembler = VectorAssembler(inputCols=feats, outputCol=FEATURES, handleInvalid="keep")
    results: dict[str, dict[str, float]] = {}
    models, errors = {}, {}
    candidates = []
    if problem == "regression":
        candidates.append(("Ridge Regression", None))
        candidates.append(("Random Forest", RandomForestRegressor(
            featuresCol=FEATURES, labelCol=LABEL, numTrees=num_trees, seed=SEED)))
        if boosted:
            candidates.append(("Gradient Boosted Trees", GBTRegressor(
                featuresCol=FEATURES, labelCol=LABEL, maxIter=100, seed=SEED)))
    else:
        candidates.append(("Random Forest", RandomForestClassifier(
            featuresCol=FEATURES, labelCol=LABEL, numTrees=num_trees, seed=SEED)))
        if boosted:
            n_classes = target_codes.count()
            gbt = GBTClassifier(featuresCol=FEATURES, labelCol=LABEL, maxIter=100, seed=SEED)
            candidates.append(("Gradient Boosted Trees",
                               gbt if n_classes <= 2 else OneVsRest(classifier=gbt, featuresCol=FEATURES,
                                                                     labelCol=LABEL)))
    preds = {}
    for name, est in candidates:
        try:
            if est is None:
                model = fit_ridge(train, feats, LABEL, alpha)
                p = model.transform(test)
            else:
                model = est.fit(assembler.transform(train))
                p = model.transform(assembler.transform(test))
            results[name] = regression_metrics(p) if problem == "regression" else {"Accuracy": accuracy(p)}
            models[name], preds[name] = model, p
        except Exception as exc:  # recorded and skipped, like the reference
            errors[name] = str(exc).splitlines()[0]
    key = "R2" if problem == "regression" else "Accuracy"
    valid = [m for m in results if not math.isnan(results[m][key])]
    best = max(valid, key=lambda m: results[m][key]) if valid else None   # first on ties
    score_rows = [(m, k, float(v)) for m, d in results.items() for k, v in d.items()]
    scores = spark.createDataFrame(score_rows, _SCORE_SCHEMA)
    imp_rows = []
    if best and hasattr(models[best], "featureImportances"):
        imp = models[best].featureImportances.toArray()
        imp_rows = sorted(((feats[i], round(float(v), 4)) for i, v in enumerate(imp)), key=lambda x: -x[1])[:10]
    importances = spark.createDataFrame(imp_rows, "feature string, importance double")
    if best:
        p = preds[best]
        order = [q(c) for c in (order_by or feats)] + [F.col(LABEL)]
        first = p.select(*feats, LABEL, "prediction").orderBy(*order).limit(100)
        # A window over the 100-row top-K only: bounded, so no partitioning needed.
        sample = first.select((F.row_number().over(Window.orderBy(*order)) - 1).alias("index"),
                              F.col(LABEL).alias("actual"), F.col("prediction").alias("predicted"))
        if problem == "classification":
            codes = target_codes
            sample = (sample.join(codes.withColumnRenamed("value", "actual_label"), sample.actual == codes.code, "left")
                            .drop("code")
                            .join(codes.withColumnRenamed("value", "predicted_label"),
                                  sample.predicted == F.col("code"), "left")
                            .select("index", F.col("actual_label").alias("actual"),
                                    F.col("predicted_label").alias("predicted")))
        else:
            sample = sample.select("index", F.round("actual", 4).alias("actual"), F.round("predicted", 4).alias("predicted"))
    else:
        sample = spark.createDataFrame([], "index bigint, actual string, predicted string")
    return MLResult(problem, target, feats, scores, best, results.get(best, {}), importances, sample, errors)


def bi_forecast(df: DataFrame, rev: str, order_by: list[str], exclude: tuple[str, ...] = ("Profit", "Profit_Margin_%"),
                num_trees: int = 100) -> dict:
    """Forest on every other numeric column (nulls as 0), then predict the last row.

    ``exclude`` keeps derived columns out of the features (the reference
    leaks the target through Profit; pass ``exclude=()`` to reproduce that).
    """
    nums = [c for c in numeric_columns(df) if c != rev and c not in exclude]
    if not nums:
        base = row_index(df.where(q(rev).isNotNull()).select(q(rev).cast("double").alias(LABEL), *[q(c) for c in order_by]),
                         order_by, name="index")
        nums = ["index"]
        data = base.select(F.col("index").cast("double").alias("index"), LABEL, *[q(c) for c in order_by])
    else:
        data = df.select(*[F.coalesce(q(c).cast("double"), F.lit(0.0)).alias(c) for c in nums],
                         F.coalesce(q(rev).cast("double"), F.lit(0.0)).alias(LABEL),
                         *[q(c) for c in order_by if c not in nums and c != rev])
    plan, data = data, written(data, forest_rows(num_trees, len(nums)))  # read by every fit and score
    train, test = split(data)
    assembler = VectorAssembler(inputCols=nums, outputCol=FEATURES)
    model = RandomForestRegressor(featuresCol=FEATURES, labelCol=LABEL, numTrees=num_trees, seed=SEED).fit(
        assembler.transform(train))
    p = model.transform(assembler.transform(test))
    m = regression_metrics(p)
    last = plan.orderBy(*[F.desc(q(c)) for c in order_by]).limit(1)  # of the plan, where an order by `rev` finds it
    next_pred = round(model.transform(assembler.transform(last)).first()["prediction"], 2)
    avg = round(data.agg(F.avg(LABEL).alias("a")).first()["a"] or 0.0, 2)
    growth = round((next_pred - avg) / avg * 100, 2) if avg != 0 else 0.0
    imp = model.featureImportances.toArray()
    fi = sorted(((nums[i], round(float(v) * 100, 1)) for i, v in enumerate(imp)), key=lambda x: -x[1])[:5]
    return {"r2": m["R2"], "mae": round(m["MAE"], 2), "next_prediction": next_pred, "current_avg": avg,
            "growth_pct": growth, "feature_importance": dict(fi), "model": "Random Forest"}


def analyst_metrics(df: DataFrame, num_trees: int = 50) -> dict[str, float]:
    """M17 inputs (analyst flavour): forest on numeric columns, last numeric is the target, mean-filled."""
    nums = numeric_columns(df)
    if len(nums) < 2:
        return {}
    target, feats = nums[-1], nums[:-1]
    means = df.agg(*[F.avg(q(c)).alias(f"a{i}") for i, c in enumerate(nums)]).first()
    data = df.select(*[F.coalesce(q(c).cast("double"), F.lit(means[f"a{i}"] or 0.0)).alias(c if c != target else LABEL)
                       for i, c in enumerate(nums)])
    if data.count() <= 10:
        return {}
    data = written(data, forest_rows(num_trees, len(feats)))
    train, test = split(data)
    assembler = VectorAssembler(inputCols=feats, outputCol=FEATURES)
    model = RandomForestRegressor(featuresCol=FEATURES, labelCol=LABEL, numTrees=num_trees, seed=SEED).fit(
        assembler.transform(train))
    m = regression_metrics(model.transform(assembler.transform(test)))
    return {"R2": m["R2"], "RMSE": m["RMSE"]}


def accuracy_score(metrics: dict[str, float], quality: int) -> float:
    """R2 when a model was scored, else the quality score."""
    return round(metrics["R2"], 4) if metrics and "R2" in metrics and not math.isnan(metrics["R2"]) else quality
