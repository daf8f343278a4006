"""Queries on header matching, cleaning, CSV files and the models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from catalog.registry import longs, query, r, rounded
from catalog.views import EVENTS_SQL, RISK_SQL, dirty, event_facts, events, raw_risk, table, write_lines
from ledgerline.functions.times import epoch_micros
from ledgerline.operators import batch, categorizer, cleaning, facts, features, forest, risk
from ledgerline.operators.forest_stage import IsolationForestStage
from ledgerline.plans.insights import facts_from_raw
from ledgerline.plans import training
from ledgerline.session import scratch_path, stage_evenly
from ledgerline.sources import csv, headers, records, sinks

EV = "WITH " + EVENTS_SQL

# What the flaws of the dirty view must come out as. A slash date is read month first when it can be.
FLAW = "txn_id % 20"
SECONDS = "date_trunc('second', ts)"
SWAPPED = f"make_timestamp(year(ts), day(ts), month(ts), hour(ts), minute(ts), CAST(second(ts) AS DOUBLE))"
DEFAULT_TIME = f"CASE {FLAW} WHEN 4 THEN NULL WHEN 5 THEN CASE WHEN day(ts) <= 12 THEN {SWAPPED} ELSE {SECONDS} END ELSE ts END"
DAY_FIRST_TIME = f"CASE {FLAW} WHEN 4 THEN NULL WHEN 5 THEN {SECONDS} ELSE ts END"
PLAIN_AMOUNT = f"CASE WHEN {FLAW} IN (1, 2, 3, 7) THEN NULL ELSE amount END"
CURRENCY_AMOUNT = f"CASE WHEN {FLAW} IN (2, 3, 7) THEN NULL WHEN {FLAW} = 1 THEN round(amount * 1000 + 1000, 2) ELSE amount END"
MERCHANT = f"CASE WHEN {FLAW} = 6 THEN '' ELSE merchant END"
DIRTY_SQL = f"""{EV}, c AS (SELECT txn_id, {DEFAULT_TIME} AS t, {DAY_FIRST_TIME} AS t_day_first, {PLAIN_AMOUNT} AS a, {CURRENCY_AMOUNT} AS a_currency, {MERCHANT} AS m, category, city, state FROM f)"""
CLEAN_SQL = f"{DIRTY_SQL} SELECT txn_id, epoch_us(t) AS micros, m AS merchant, {r('a')} AS amount FROM c WHERE t IS NOT NULL AND a IS NOT NULL"


def _micros():
    return epoch_micros(F.col("timestamp")).alias("micros")


def _id():
    return F.col("`Unnamed: 0`").cast("long")


def _aligned(spark, sf):
    return headers.align_strict(dirty(spark, sf).withColumn("txn_id", _id()), keep=("txn_id",))


def _shown(df):
    return rounded(df.select("txn_id", _micros(), "merchant", "amount"), amount=4)


# ------------------------------------------------------------------ cleaning


@query("clean_core", CLEAN_SQL)
def clean_core(spark, sf):
    return _shown(cleaning.clean(_aligned(spark, sf)))


@query("clean_currency", f"{DIRTY_SQL} SELECT txn_id, {r('a_currency')} AS amount FROM c WHERE t IS NOT NULL AND a_currency IS NOT NULL")
def clean_currency(spark, sf):
    return rounded(cleaning.clean(_aligned(spark, sf), currency=True).select("txn_id", "amount"), amount=4)


@query("clean_dayfirst", f"{DIRTY_SQL} SELECT txn_id, epoch_us(t_day_first) AS micros FROM c WHERE t_day_first IS NOT NULL AND a IS NOT NULL")
def clean_dayfirst(spark, sf):
    return cleaning.clean(_aligned(spark, sf), day_first=True).select("txn_id", _micros())


@query("clean_inf", f"{EV} SELECT txn_id, {r('amount')} AS amount FROM f WHERE txn_id % 7 NOT IN (1, 2, 3)")
def clean_inf(spark, sf):
    flaw = F.col("txn_id") % 7
    amount = (
        F.when(flaw == 1, F.lit(float("inf")))
        .when(flaw == 2, F.lit(float("-inf")))
        .when(flaw == 3, F.lit(float("nan")))
        .otherwise(F.col("amount"))
    )
    rows = events(spark, sf).withColumn("amount", amount)
    return rounded(cleaning.clean(rows).select("txn_id", "amount"), amount=4)


@query("clean_merchant", f"{DIRTY_SQL} SELECT m AS merchant, count(*) AS n FROM c WHERE t IS NOT NULL AND a IS NOT NULL GROUP BY 1")
def clean_merchant(spark, sf):
    return cleaning.clean(_aligned(spark, sf)).groupBy("merchant").agg(F.count("*").alias("n"))


@query(
    "clean_drop_report",
    f"""{DIRTY_SQL} SELECT count(*) AS rows_in, count(CASE WHEN t IS NOT NULL AND a IS NOT NULL THEN 1 END) AS kept,
    count(CASE WHEN t IS NULL OR a IS NULL THEN 1 END) AS dropped FROM c""",
)
def clean_drop_report(spark, sf):
    return cleaning.drop_report(_aligned(spark, sf))


# ------------------------------------------------------------------ headers

ALIGNED_SQL = f"""{EV} SELECT txn_id, epoch_us(ts) AS micros, merchant_raw AS merchant, amount, CAST(user_id % 7 AS VARCHAR) AS city, category
FROM (SELECT f.*, cc_num AS user_id FROM f)"""


def _renamed(spark, sf, names):
    rows = events(spark, sf).withColumn("city", F.regexp_extract("city", "([0-9]+)", 1))
    return rows.select("txn_id", *[F.col(old).alias(new) for old, new in names.items()])


def _with_micros(df):
    return df.select("txn_id", _micros(), "merchant", "amount", "city", "category")


@query("schema_match", ALIGNED_SQL)
def schema_match(spark, sf):
    names = {"timestamp": " Transaction Time ", "merchant": "PAYEE", "amount": "txn_amt", "city": "Billing-City", "category": "Label", "k": "Value Code"}
    return _with_micros(headers.align_canonical(_renamed(spark, sf, names), keep=("txn_id",)))


@query("schema_match_fallback", ALIGNED_SQL)
def schema_match_fallback(spark, sf):
    names = {"k": "code", "merchant": "Narrative Text", "timestamp": "posting_ts", "amount": "Gross Amount USD", "city": "city", "category": "class"}
    return _with_micros(headers.align_canonical(_renamed(spark, sf, names), keep=("txn_id",)))


@query("align_canonical", ALIGNED_SQL)
def align_canonical(spark, sf):
    names = {n: n for n in ("category", "city", "amount", "merchant", "timestamp", "cc_num")}
    return _with_micros(headers.align_canonical(_renamed(spark, sf, names), keep=("txn_id",)))


@query("align_strict", f"{EV} SELECT txn_id, epoch_us(ts) AS micros, merchant_raw AS merchant, amount, category, lower(city) AS city, lower(state) AS state FROM f")
def align_strict(spark, sf):
    rows = headers.align_strict(raw_risk(spark, sf), keep=("txn_id",))
    return rows.select("txn_id", _micros(), "merchant", "amount", "category", F.lower("city").alias("city"), F.lower("state").alias("state"))


@query(
    "train_prepare",
    f"{DIRTY_SQL} SELECT txn_id, epoch_us(t) AS micros, m AS merchant, {r('a')} AS amount, category, lower(city) AS city, lower(state) AS state FROM c WHERE t IS NOT NULL AND a IS NOT NULL AND category <> 'error'",
)
def train_prepare(spark, sf):
    labelled = F.when(F.col("category") != "error", F.col("category"))
    prepared = training.prepare_training(dirty(spark, sf).withColumns({"txn_id": _id(), "category": labelled}))
    columns = ["category", F.lower("city").alias("city"), F.lower("state").alias("state")]
    return rounded(prepared.select("txn_id", _micros(), "merchant", "amount", *columns), amount=4)


@query("category_fallback", f"{EV} SELECT txn_id, CASE WHEN k % 17 = 0 THEN 'uncategorized' ELSE category END AS pred_category FROM f")
def category_fallback(spark, sf):
    given = F.when(F.col("k") % 17 != 0, F.col("category"))
    return facts.category_fallback(events(spark, sf).withColumn("category", given)).select("txn_id", "pred_category")


@query(
    "batch_classify_align",
    f"""{DIRTY_SQL} SELECT txn_id, epoch_us(t_day_first) AS micros, CASE WHEN {FLAW} = 6 THEN 'Unknown' ELSE merchant_raw END AS merchant, {r('a_currency')} AS amount
    FROM c JOIN f USING (txn_id) WHERE t_day_first IS NOT NULL AND a_currency IS NOT NULL""",
)
def batch_classify_align(spark, sf):
    return _shown(cleaning.clean_batch(headers.align_batch(dirty(spark, sf))).withColumn("txn_id", _id()))


@query(
    "batch_classify_features",
    f"""WITH {RISK_SQL} SELECT txn_id, cust_lat AS lat, cust_long AS long, 0.0::DOUBLE AS city_pop, merch_lat, coalesce(merch_long, 0) AS merch_long, CAST(cc_num AS DOUBLE) AS cc_num,
    CAST(hour(ts) AS DOUBLE) AS "Hour", CAST(isodow(ts) - 1 AS DOUBLE) AS "DayOfWeek", {r('abs(amount)')} AS "AbsAmount" FROM g""",
)
def batch_classify_features(spark, sf):
    names = ["lat", "long", "city_pop", "merch_lat", "merch_long", "cc_num", "Hour", "DayOfWeek", "AbsAmount"]
    rows = cleaning.clean_batch(headers.align_batch(raw_risk(spark, sf)))
    return rounded(features.batch_features(rows, names).select("txn_id", *names), AbsAmount=4)


# ------------------------------------------------------------------ CSV files


@query("csv_ingest", CLEAN_SQL)
def csv_ingest(spark, sf):
    path = scratch_path(spark, "csv-ingest")
    sinks.write_csv(dirty(spark, sf), path)
    rows = csv.read_transactions(spark, path).withColumn("txn_id", _id())
    return _shown(cleaning.clean(headers.align_canonical(rows, keep=("txn_id", "Unnamed: 0"))))


@query(
    "csv_quarantine",
    f"""{EV} SELECT CASE txn_id % 20 WHEN 8 THEN 'padded' WHEN 9 THEN 'quarantined' ELSE 'kept' END AS status, count(*) AS n, CAST(sum(txn_id) AS BIGINT) AS ids FROM f GROUP BY 1""",
)
def csv_quarantine(spark, sf):
    flaw = F.col("txn_id") % 20
    cells = [F.col("txn_id").cast("string"), F.col("timestamp").cast("string"), F.concat(F.lit('"'), "merchant", F.lit(', Ltd"'))]
    short, full = F.concat_ws(",", *cells), F.concat_ws(",", *cells, F.col("amount").cast("string"))
    line = (
        F.when(flaw == 8, short)
        .when(flaw == 9, F.concat(full, F.lit(",extra")))
        .when(flaw == 10, F.concat(F.lit("\n"), full))
        .otherwise(full)
    )
    path = scratch_path(spark, "csv-quarantine")
    write_lines(events(spark, sf).select(line.alias("value")), ["id,date,merchant,amount"], path)
    usable = csv.read_transactions(spark, path).select(
        F.when(F.col("amount").isNull(), F.lit("padded")).otherwise(F.lit("kept")).alias("status"), F.col("id").cast("long").alias("id")
    )
    refused = csv.read_quarantine(spark, path).select(
        F.lit("quarantined").alias("status"), F.element_at(F.split("record", ","), 1).cast("long").alias("id")
    )
    return usable.unionByName(refused).groupBy("status").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("csv_header_probe", f"{EV} SELECT txn_id, epoch_us(ts) AS micros, merchant, {r('amount')} AS amount FROM f")
def csv_header_probe(spark, sf):
    names = [
        "Unnamed: 0", "trans_date_trans_time", "cc_num", "merchant", "category", "amt", "city", "state",
        "lat", "long", "merch_lat", "merch_long",
    ]
    raw = raw_risk(spark, sf).withColumn("Unnamed: 0", F.col("txn_id"))
    cells = [F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names]
    lines = raw.select(F.concat_ws(",", *cells).alias("value"))
    numbers = ",".join(str(i) for i in range(len(names)))
    path = scratch_path(spark, "csv-header-probe")
    write_lines(lines, [numbers, ",".join(names)], path)
    rows = csv.read_transactions(spark, path).withColumn("txn_id", _id())
    return _shown(cleaning.clean(headers.align_strict(rows, keep=("txn_id",))))


@query("csv_roundtrip", f"""{EV} SELECT txn_id, merchant, {r('amount')} AS amount, category || ',' || pred_category AS labels FROM f""")
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv-roundtrip")
    found = event_facts(spark, sf).select("txn_id", "merchant", "amount", F.array("category", "pred_category").alias("labels"))
    sinks.write_csv(found, path)
    return rounded(longs(csv.read_transactions(spark, path), "txn_id"), amount=4)


@query(
    "csv_multiline",
    f"""{EV} SELECT CASE WHEN txn_id % 20 = 9 THEN 'long' ELSE 'kept' END AS status, txn_id,
    CASE WHEN txn_id % 20 <> 9 THEN 'Say ""' || merchant_raw || '""' || CASE WHEN txn_id % 3 = 0 THEN chr(10) || 'second, line' || chr(10) || chr(10) || 'fourth' ELSE '' END END AS merchant,
    {r("CASE WHEN txn_id % 20 <> 9 THEN amount END")} AS amount FROM f""".replace('""', '"'),
)
def csv_multiline(spark, sf):
    """Quoted merchants over several lines, read from splits of 64 kB that cut through them."""
    more = F.when(F.col("txn_id") % 3 == 0, F.lit("\nsecond, line\n\nfourth")).otherwise(F.lit(""))
    merchant = F.concat(F.lit('"Say ""'), "merchant", F.lit('""'), more, F.lit('"'))
    cells = [F.col("txn_id").cast("string"), merchant, F.col("amount").cast("string")]
    line = F.concat(F.concat_ws(",", *cells), F.when(F.col("txn_id") % 20 == 9, F.lit(",extra")).otherwise(F.lit("")))
    path = scratch_path(spark, "csv-multiline")
    write_lines(events(spark, sf).select(line.alias("value")), ["id,merchant,amount"], path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 16))
    try:
        found = records.read_records(spark, path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    usable = found.rows.select(F.lit("kept").alias("status"), F.col("id").cast("long").alias("txn_id"), "merchant", F.col("amount").cast("double").alias("amount"))
    refused = found.refused.select(
        F.col("reason").alias("status"), F.element_at(F.split("record", ","), 1).cast("long").alias("txn_id"),
        F.lit(None).cast("string").alias("merchant"), F.lit(None).cast("double").alias("amount"),
    )
    return rounded(usable.unionByName(refused), amount=4)


@query("csv_mixed_headers", f"{EV} SELECT epoch_us(ts) AS micros, merchant, {r('amount')} AS amount, CASE WHEN txn_id % 4 <> 2 THEN category END AS category FROM f")
def csv_mixed_headers(spark, sf):
    """Four kinds of files in one folder: three orders and wordings, one with a line of numbers above the header."""
    rows = events(spark, sf)
    time, amount = F.col("timestamp").cast("string"), F.col("amount").cast("string")
    filler = [F.lit("x")] * 6
    kinds = [
        (["Transaction Time", "Payee", "Amt", "Category"], [time, F.col("merchant"), amount, F.col("category")], False),
        (["category", "amount", "merchant", "timestamp"], [F.col("category"), amount, F.col("merchant"), time], False),
        (["note", "TXN_AMT", "Posting Date", "narrative"], [F.lit(""), amount, time, F.col("merchant")], False),
        (
            ["Unnamed: 0", "trans_date_trans_time", "merchant", "category", "amt", *(f"more{k}" for k in range(6))],
            [F.col("txn_id").cast("string"), time, F.col("merchant"), F.col("category"), amount, *filler],
            True,
        ),
    ]
    path = scratch_path(spark, "csv-mixed")
    for k, (names, cells, shifted) in enumerate(kinds):
        above = [",".join(map(str, range(len(names))))] if shifted else []
        lines = rows.where(F.col("txn_id") % len(kinds) == k).select(F.concat_ws(",", *cells).alias("value"))
        write_lines(lines, [*above, ",".join(names)], f"{path}/kind={k}")
    found = records.read_records(spark, path, records.canonical_names)
    return rounded(cleaning.clean(found.rows).select(_micros(), "merchant", "amount", "category"), amount=4)


# ------------------------------------------------------------------ models


def _categorized(spark, sf):
    """Fitted on a bounded sample, then every cleaned row of the table predicted."""
    raw = raw_risk(spark, sf)
    trained = training.train_categorizer(training.prepare_training(raw))
    return facts_from_raw(headers.align_strict(raw, keep=("txn_id",)), trained.model, trained.edges)


@query("categorize")
def categorize(spark, sf):
    return _categorized(spark, sf).select("txn_id", "category", "pred_category")


@query("categorize_text")
def categorize_text(spark, sf):
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("txn_id"), "text", F.col("lang").alias("category"))
    model = categorizer.fit_categorizer(documents, text="text", numeric=[])
    return categorizer.categorize(documents, model, numeric=[], text="text").select("txn_id", "category", "pred_category")


def _batch_rows(spark, sf):
    """Cleaned rows, staged: the fit and each prediction read them, all cores at a time."""
    return stage_evenly(cleaning.clean_batch(headers.align_batch(raw_risk(spark, sf))), "batch-rows")


def _batch(spark, sf, kind):
    rows = _batch_rows(spark, sf)
    return batch.batch_classify(rows, batch.fit_batch_classifier(rows, kind=kind)).select("txn_id", "amount", "predicted_category")


@query("batch_classify")
def batch_classify(spark, sf):
    return _batch(spark, sf, "rf")


@query("batch_classify_mlp")
def batch_classify_mlp(spark, sf):
    return _batch(spark, sf, "mlp")


BATCH_ROWS_SQL = f"WITH {RISK_SQL} SELECT count(*) AS n_rows, count(*) AS n_equal FROM g WHERE amount IS NOT NULL"


def _batch_by_tables(spark, sf, kind):
    """How many rows the model's tables and the model itself predict alike."""
    rows = _batch_rows(spark, sf)
    model = batch.fit_batch_classifier(rows, kind=kind)
    own = batch.classify_by_tables(rows, model).withColumnRenamed("predicted_category", "own")
    both = batch.batch_classify(rows, model).join(own, "txn_id")
    equal = F.count(F.when(F.col("own").eqNullSafe(F.col("predicted_category")), 1))
    return both.agg(F.count("*").alias("n_rows"), equal.alias("n_equal"))


@query("batch_forest_by_tables", BATCH_ROWS_SQL)
def batch_forest_by_tables(spark, sf):
    return _batch_by_tables(spark, sf, "rf")


@query("batch_mlp_by_tables", BATCH_ROWS_SQL)
def batch_mlp_by_tables(spark, sf):
    return _batch_by_tables(spark, sf, "mlp")


GRADIENT_BOUND = 1e-3


@query("categorize_residual", "SELECT lang AS category, count(*) AS n, TRUE AS optimal FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def categorize_residual(spark, sf):
    """The fit of ``categorize_text`` proved by its gradient: a row per label, optimal within a stated bound."""
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("txn_id"), "text", F.col("lang").alias("category"))
    model = categorizer.fit_categorizer(documents, text="text", numeric=[], tolerance=1e-7)
    found = categorizer.optimality(documents, model, text="text", numeric=[])
    return found.select("category", "n", (F.col("gradient") < GRADIENT_BOUND).alias("optimal"))


@query(
    "model_roundtrip",
    f"""WITH {RISK_SQL} SELECT 'forest' AS model, count(*) AS n_rows, count(*) AS n_equal FROM g
    UNION ALL SELECT 'categories', count(*), count(*) FROM documents""",
)
def model_roundtrip(spark, sf):
    """Both kinds of models saved and loaded as pipelines, and the rows that each predicts as before."""
    facts_ = features.geo_distance(risk.risk_base(raw_risk(spark, sf)))
    fitted, _ = forest.fit_isolation_forest(facts_.select("txn_id", "amount", "geo_dist_km"), ["amount", "geo_dist_km"], trees=32, sample_size=128)
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("txn_id"), "text", F.col("lang").alias("category"))
    pipelines = [
        ("forest", PipelineModel([IsolationForestStage(fitted)]), facts_.select("txn_id", "amount", "geo_dist_km"), "anomaly_score"),
        ("categories", categorizer.fit_categorizer(documents, text="text", numeric=[], max_iterations=20), documents.na.fill("", ["text"]), "pred_category"),
    ]
    results = []
    for name, model, rows, shown in pipelines:
        path = scratch_path(spark, "model")
        model.write().save(path)
        before = model.transform(rows).select("txn_id", F.col(shown).alias("before"))
        after = PipelineModel.load(path).transform(rows).select("txn_id", F.col(shown).alias("after"))
        equal = F.count(F.when(F.col("before").eqNullSafe(F.col("after")), 1))
        both = before.join(after, "txn_id").agg(F.count("*").alias("n_rows"), equal.alias("n_equal"))
        results.append(both.select(F.lit(name).alias("model"), "n_rows", "n_equal"))
    return results[0].unionByName(results[1])
