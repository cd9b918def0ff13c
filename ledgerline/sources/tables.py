"""Logical inputs of the engine as views over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c) -> F.Column:
    return c.cast("decimal(18,2)")


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with customer and nation; dates of every 11th and totals of every 13th order are missing."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    status = F.when(F.col("o_orderstatus") == "F", "OK").when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("REVIEW")
    return joined.select(
        F.col("o_orderkey").alias("invoice_id"), F.col("o_orderkey").cast("string").alias("invoice_number"), F.col("n_name").alias("supplier_name"), F.col("c_name").alias("customer_name"), F.col("o_custkey").alias("file_id"),
        F.when(F.col("o_orderkey") % 11 != 0, F.to_date("o_orderdate")).alias("invoice_date"), F.when(F.col("o_orderkey") % 13 != 0, money(F.col("o_totalprice"))).alias("total_amount"), status.alias("status"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as invoice lines; n_rows stands for the text rows a line wraps over."""
    price, part = money(F.col("l_extendedprice")), F.col("l_discount").cast("decimal(4,2)")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("line_number"), F.col("l_partkey").alias("part_id"), F.col("l_quantity").cast("decimal(18,2)").alias("quantity"), part.alias("discount"),
        (price / F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(18,4)").alias("unit_price"), F.round(price * (F.lit(1).cast("decimal(4,2)") - part), 2).cast("decimal(18,2)").alias("line_total"), (F.col("l_linenumber") % 3 + 1).alias("n_rows"),
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices with a header total near their lines' sum (off by a step that the key sets) and two confidences, so that every status occurs."""
    sums = lines(spark, sf_dir).groupBy("invoice_id").agg(F.sum("line_total").alias("_s"))
    k = F.col("invoice_id")
    off = F.when(k % 5 == 0, F.lit("25.50")).when(k % 5 == 1, F.lit("0.75")).when(k % 5 == 2, F.lit("3.25")).otherwise(F.lit("0.00")).cast("decimal(18,2)")
    inv = invoices(spark, sf_dir).join(sums, "invoice_id", "left").drop("status", "total_amount")
    return inv.select("*", F.when(k % 17 != 0, F.coalesce("_s", F.lit(0)) + off).cast("decimal(28,2)").alias("header_total"), (F.lit(0.99) - (k % 7 == 0).cast("int") * 0.09).alias("number_confidence"), (F.lit(0.97) - (k % 19 == 0).cast("int") * 0.05).alias("total_confidence")).drop("_s")


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as corrections: invoice = user, arrival = event id."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("invoice_id"), F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("supplier_name"), F.when(F.col("event_id") % 6 != 0, money(F.col("value"))).alias("corrected_total"),
        F.when(F.col("event_id") % 10 != 0, F.round(F.col("event_id") % 97 / F.lit(97.0), 4)).alias("confidence"), F.col("event_id").alias("arrival"), F.col("ts").cast("timestamp_ntz").alias("ts"),
    )


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as learned patterns with integer positions."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        i.alias("pattern_id"), F.col("event_type").alias("supplier_name"), F.md5(F.concat(F.col("event_type"), F.lit("footer")).cast("binary")).alias("layout_hash"), F.when(i % 4 != 0, (i * 37 % 600).cast("double")).alias("position_x"), F.when(i % 4 != 0, (i * 53 % 800).cast("double")).alias("position_y"),
        (i % 3).cast("double").alias("correct_total"), F.lit(0.1).alias("confidence_boost"), (i % 5).cast("int").alias("usage_count"), F.col("ts").cast("timestamp_ntz").alias("last_used"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels with documents as calibration truth: raw_confidence from the text's length and id, correct = quality."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    raw = F.round(F.least(F.lit(1.0), F.col("n_chars") % 1000 / F.lit(1000.0) * 0.6 + F.col("doc_id") % 41 / F.lit(100.0)), 6)
    return l.join(d.select("doc_id", "n_chars", "lang", "source"), "doc_id").select("doc_id", raw.alias("raw_confidence"), (F.col("quality") == 1).alias("actual_correct"), F.col("source").alias("supplier"), F.col("lang").alias("field"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents as positioned tokens: y steps unevenly, x by place in the row."""
    d = table(spark, sf_dir, "documents")
    word = d.select("doc_id", F.posexplode(F.split(F.trim(F.regexp_replace("text", r"[ \n\t\r]+", " ")), " ")).alias("token_idx", "text"))
    i = F.col("token_idx")
    return word.select("doc_id", F.floor(i / 200).cast("int").alias("page_number"), "token_idx", "text", (i % 8 * 70.0).alias("x"), (F.floor(i % 200 / 8) * 30.0 + i % 8 * 1.25).alias("y"), F.lit(50.0).alias("width"), (i % 5 + 8.0).alias("height"), F.lit(792.0).alias("page_height"), F.lit(612.0).alias("page_width"))


def _text_rows(orders: DataFrame, first_y: float, *texts: F.Column) -> DataFrame:
    """One row for each of ``texts`` that is not null, 20 points apart on an 800-point page."""
    rows = orders.select("invoice_id", F.posexplode(F.array(*texts)).alias("row_idx", "text")).filter("text is not null")
    return rows.select("invoice_id", "row_idx", (F.col("row_idx") * 20 + first_y).cast("double").alias("y"), F.lit(800.0).alias("page_height"), "text")


def rendered_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header rows of every order; the key sets the layout."""
    k = F.col("o_orderkey")
    number = (k + 1000000).cast("string")
    shown = F.when(k % 4 == 0, F.lit("Fakturanummer")).when(k % 4 == 3, F.lit("Kund")).otherwise(F.concat(F.lit("Faktura nr: "), number))
    below = F.when(k % 4 == 0, number).when(k % 4 == 3, F.concat(F.lit("ID "), number)).otherwise("2024-08-22")
    return _text_rows(
        table(spark, sf_dir, "orders").withColumn("invoice_id", k), 20.0, F.concat(F.lit("Sida 1/"), (k % 3 + 1).cast("string")), F.when(k % 2 == 0, F.lit("Norra Verkstaden")), F.when(k % 3 != 0, F.concat(F.lit("Bygg "), F.translate(F.col("o_custkey").cast("string"), "0123456789", "abcdefghij"), F.lit(" AB"))),
        shown, below, F.when(k % 5 != 0, F.concat(F.lit("Er referens: RF "), k.cast("string"))),
    )


def rendered_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summation rows of every order: net, VAT and gross; every third order has the gross amount one row below its label."""
    o = table(spark, sf_dir, "orders")
    k, net = F.col("o_orderkey"), money(F.col("o_totalprice"))
    shown = lambda v: F.translate(F.format_number(v, 2), ",.", " ,")
    gross = shown((net * 2).cast("decimal(18,2)"))
    return _text_rows(
        o.withColumn("invoice_id", k), 600.0, F.concat(F.lit("Nettobelopp exkl. moms "), shown(net)), F.lit("Moms"), F.when(k % 3 == 0, F.lit("Att betala")).otherwise(F.concat(F.lit("Att betala "), gross, F.lit(" kr"))), F.when(k % 3 == 0, gross),
    )


def rendered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows of all lineitems: article, words, quantity, price; every third line wraps over a second row."""
    l = table(spark, sf_dir, "lineitem")
    k = F.row_number().over(_line_order())
    shown = lambda v: F.translate(money(v).cast("string"), ".", ",")
    text = F.concat(F.lit("70000"), F.col("l_partkey").cast("string"), F.lit(" Skruv rostfri stor "), F.col("l_quantity").cast("int").cast("string"), F.lit(" st "), shown(F.col("l_extendedprice")))
    rows = l.select(F.col("l_orderkey").alias("invoice_id"), k.alias("_k"), text.alias("_t"))
    rows = rows.select("invoice_id", "_k", F.posexplode(F.when(F.col("_k") % 3 == 0, F.array("_t", F.lit("med bricka"))).otherwise(F.array("_t"))).alias("_p", "text"))
    return rows.select("invoice_id", (F.col("_k") * 2 + F.col("_p")).cast("int").alias("row_idx"), "text")


def _line_order() -> WindowSpec:
    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
