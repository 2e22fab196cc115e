"""Queries that write tables in the formats of the sources and read them back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.plans.registry import query
from sparkloom.session import scratch_dir
from sparkloom.sources import readers as rd
from sparkloom.sources.artifacts import completed_cases, read_artifact, write_artifact


def frames(t):
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
    one = t.events.groupBy(day.alias("frame_id"), F.col("user_id").alias("camera_id")).agg(F.min("event_id").alias("e"))
    return one.select("frame_id", (F.col("frame_id") * 86_400_000_000_000).alias("timestamp_ns"), "camera_id", F.concat(F.lit("cam/"), F.col("e").cast("string"), F.lit(".jpg")).alias("image_name"))


@query("s1_frame_table", "SELECT epoch_us(ts) // 86400000000 AS frame_id, epoch_us(ts) // 86400000000 * 86400000000000 AS timestamp_ns, user_id AS camera_id, 'cam/' || min(event_id) || '.jpg' AS image_name FROM events GROUP BY ALL")
def _(t):
    path = f"{scratch_dir(t.spark)}/frames.csv"
    frames(t).write.csv(path, header=True)
    return rd.read_frame_table(t.spark, path)


def _images():
    """Images that stand for a line's supplier and part: even and odd, so that the two are never one, however many there are."""
    return 2 * F.col("l_suppkey"), 2 * F.col("l_partkey") + 1


def _own_key(image: str):
    """The key that the SQL has for an image of :func:`_images`."""
    return F.shiftright(image, 1) + F.when(F.col(image) % 2 == 1, 1000).otherwise(0)


@query("s2_finalized_pairs", "SELECT l_suppkey AS img1, l_partkey + 1000 AS img2, l_linestatus AS config, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL")
def _(t):
    a, b = _images()
    pairs = t.lineitem.select(a.alias("img1"), b.alias("img2"), F.when(F.col("l_returnflag") == "A", "DEGENERATE").otherwise(F.col("l_linestatus")).alias("config"))
    counts = rd.finalized_pairs(pairs).groupBy("img1", "img2", "config").agg(F.count("*").alias("n"))
    return counts.select(_own_key("img1").alias("img1"), _own_key("img2").alias("img2"), "config", "n")


@query("s3_first_pair_wins", "SELECT l_suppkey AS a, l_partkey AS b, min(l_orderkey) AS o, (min(l_orderkey) + 0.5)::FLOAT AS x FROM lineitem GROUP BY 1, 2")
def _(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_orderkey").alias("o"))
    w = Window.partitionBy("a", "b").orderBy("o")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("a", "b", "o", (F.col("o") + 0.5).cast("float").alias("x"))


@query("s4_tracking_prefix", "SELECT image_id, feature_id FROM (SELECT l_suppkey AS image_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS feature_id FROM lineitem) WHERE feature_id < image_id % 10 + 5")
def _(t):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    f = t.lineitem.select(F.col("l_suppkey").alias("image_id"), (F.row_number().over(w) - 1).cast("bigint").alias("feature_id"))
    return rd.tracking_features(f, t.supplier.select(F.col("s_suppkey").alias("image_id"), (F.col("s_suppkey") % 10 + 5).alias("n_tracking")))


@query("s5_sparse_matches", "SELECT CASE WHEN l_suppkey % 2 = 1 THEN l_partkey + 1000 ELSE l_suppkey END AS img1, CASE WHEN l_suppkey % 2 = 1 THEN l_suppkey ELSE l_partkey + 1000 END AS img2, count(*) AS n, sum(l_orderkey)::BIGINT AS total FROM lineitem WHERE l_quantity > 10 GROUP BY l_suppkey, l_partkey")
def _(t):
    a, b = _images()
    rows = t.lineitem.groupBy(a.alias("a"), b.alias("b")).agg(F.collect_list(F.struct(F.when(F.col("l_quantity") > 10, F.col("l_orderkey")).otherwise(-1).alias("m"), F.col("l_discount").alias("s"))).alias("x"))
    packed = rows.select("a", "b", (_own_key("a") % 2 == 1).alias("reversed"), F.transform("x", lambda x: x["m"]).alias("matches0"), F.transform("x", lambda x: x["s"]).alias("scores0"))
    order = F.when(F.col("img1") % 2 == 1, F.col("feat1")).otherwise(F.col("feat2"))  # a part comes first where the pair is turned
    found = rd.sparse_matches(packed, "a", "b").groupBy("img1", "img2").agg(F.count("*").alias("n"), F.sum(order).alias("total"))
    return found.select(_own_key("img1").alias("img1"), _own_key("img2").alias("img2"), "n", "total")


@query("s6_s7_c2_c3_artifacts", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    path, config = f"{scratch_dir(t.spark)}/counts", {"least": 1, "workers": 4}
    write_artifact(t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n")), path, config, ("workers",))
    return read_artifact(t.spark, path, "l_suppkey bigint, n bigint", {"least": 1, "workers": 8}, ("workers",))


@query("c4_completed_cases", "SELECT DISTINCT o_orderpriority AS scene, 'default' AS mode, o_orderstatus AS testset FROM orders")
def _(t):
    path = f"{scratch_dir(t.spark)}/metrics"
    m = t.orders.groupBy(F.col("o_orderpriority").alias("scene"), F.col("o_orderstatus").alias("testset")).agg(F.avg("o_totalprice").alias("value"))
    rd.write_metrics(m.select("scene", F.lit("default").alias("mode"), "testset", F.lit("ate").alias("metric"), "value"), path)
    return completed_cases(t.spark, path)


@query("s8_pair_lists", "SELECT DISTINCT 's' || l_suppkey AS first, 'p' || l_partkey AS second FROM lineitem")
def _(t):
    path = f"{scratch_dir(t.spark)}/pairs"
    t.lineitem.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("first"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("second")).distinct().write.parquet(path)
    return t.spark.read.schema("first string, second string").parquet(path)


@query("s9_v11_mask_codec", "SELECT l_suppkey AS first, l_partkey AS second, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) - 1 AS row, l_returnflag = 'R' AS is_lc FROM lineitem")
def _(t):
    w = Window.partitionBy("l_suppkey", "l_partkey").orderBy("l_orderkey", "l_linenumber")
    dense = t.lineitem.select(F.col("l_suppkey").alias("first"), F.col("l_partkey").alias("second"), (F.row_number().over(w) - 1).alias("row"), (F.col("l_returnflag") == "R").alias("is_lc"))
    return rd.decode_masks(rd.encode_masks(dense, "first", "second", "row", F.col("is_lc")), "first", "second").withColumn("row", F.col("row").cast("bigint"))


@query("s10_attach_depth", "SELECT p_partkey AS image_id, k AS feature_id, CASE WHEN k < p_size % 5 THEN p_retailprice + k END AS depth, k < p_size % 5 AND p_retailprice + k > 1000 AS depth_valid FROM part, (SELECT unnest(range(5)) AS k)")
def _(t):
    f = t.part.select(F.col("p_partkey").alias("image_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("feature_id"), "p_size", "p_retailprice")
    depth = f.where("feature_id < p_size % 5").select("image_id", "feature_id", (F.col("p_retailprice") + F.col("feature_id")).alias("depth"), (F.col("p_retailprice") + F.col("feature_id") > 1000).alias("depth_valid"))
    return rd.attached_depth(f.select("image_id", "feature_id"), depth)


@query("s11_pose_file", "SELECT s_suppkey + 0.25::DOUBLE AS ts, s_acctbal AS tx FROM supplier")
def _(t):
    path = f"{scratch_dir(t.spark)}/poses.txt"
    line = F.concat_ws(" ", (F.col("s_suppkey").cast("decimal(28,9)") + F.lit("0.25").cast("decimal(28,9)")).cast("string"), F.col("s_acctbal").cast("string"), F.lit("0 1.5 0 0 0 1"))
    t.supplier.select(line.alias("value")).unionByName(t.spark.range(1).select(F.lit("# time position quaternion").alias("value"))).write.text(path)
    return rd.read_poses(t.spark, path).select(F.col("ts").cast("double").alias("ts"), "tx")


@query("s12_s13_sensors", "SELECT 'c' || s_suppkey AS sensor_id, 'PINHOLE' AS model, 640 AS width, s_acctbal AS f FROM supplier WHERE s_suppkey % 3 > 0")
def _(t):
    path = f"{scratch_dir(t.spark)}/sensors.txt"
    kind = F.when(F.col("s_suppkey") % 3 == 0, "imu").otherwise("camera")
    t.supplier.select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string"), F.lit(", name, "), kind, F.lit(", PINHOLE, 640, 480, "), F.col("s_acctbal").cast("string"), F.lit(", 500")).alias("value")).write.text(path)
    return rd.read_sensors(t.spark, path).select("sensor_id", "model", "width", F.col("params")[0].alias("f"))


@query("s14_s15_numeric_rows", "SELECT o_orderkey::DOUBLE AS a, o_totalprice AS b FROM orders")
def _(t):
    path = f"{scratch_dir(t.spark)}/rows.txt"
    t.orders.select(F.concat_ws("  ", F.col("o_orderkey").cast("string"), F.format_string("%.2f", "o_totalprice")).alias("value")).write.text(path)
    return rd.read_numeric(t.spark, path, 2).select(F.col("v")[0].alias("a"), F.col("v")[1].alias("b"))


@query("s16_testset_selection", "SELECT o_orderpriority AS scene, o_orderstatus AS testset, count(*) AS images FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2")
def _(t):
    chosen = t.spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "scene string")
    rows = t.orders.select(F.col("o_orderpriority").alias("scene"), F.col("o_orderstatus").alias("testset"))
    return rows.join(chosen, "scene", "left_semi").groupBy("scene", "testset").agg(F.count("*").alias("images"))


@query("s18_image_list", "SELECT 'img' || p_partkey || '.png' AS image_name, p_brand AS param FROM part")
def _(t):
    path = f"{scratch_dir(t.spark)}/list.txt"
    t.part.select(F.concat(F.lit("img"), F.col("p_partkey").cast("string"), F.lit(".png "), "p_brand").alias("value")).unionByName(t.spark.range(3).select(F.lit("# note").alias("value"))).write.text(path)
    return rd.read_image_list(t.spark, path).select("image_name", F.col("params")[0].alias("param"))


@query("s19_inventory", "SELECT 'f' || p_partkey AS name, p_size::BIGINT AS size, sha256(p_name) AS sha256 FROM part")
def _(t):
    path = f"{scratch_dir(t.spark)}/inventory.tsv"
    t.part.select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").cast("bigint").alias("size"), F.sha2("p_name", 256).alias("sha256")).write.csv(path, sep="\t", header=True)
    return rd.read_inventory(t.spark, path, "^f[0-9]+$")


@query("s21_metric_files", "SELECT o_orderpriority AS scene, 'default' AS mode, o_orderstatus AS testset, 'ate' AS metric, round(avg(o_totalprice), 2) AS value FROM orders GROUP BY 1, 3")
def _(t):
    path = f"{scratch_dir(t.spark)}/metrics"
    m = t.orders.groupBy(F.col("o_orderpriority").alias("scene"), F.col("o_orderstatus").alias("testset")).agg(F.round(F.avg("o_totalprice"), 2).alias("value"))
    rd.write_metrics(m.select("scene", F.lit("default").alias("mode"), "testset", F.lit("ate").alias("metric"), "value"), path)
    return rd.read_metrics(t.spark, path)


@query("s23_masked_extract", "SELECT l_suppkey AS pair, count(*) AS rows FROM lineitem WHERE l_linestatus = 'F' AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 2000) GROUP BY 1 HAVING count(*) > 0")
def _(t):
    masked = t.supplier.where("s_acctbal > 2000").select(F.col("s_suppkey").alias("pair"))
    rows = t.lineitem.where("l_linestatus = 'F'").select(F.col("l_suppkey").alias("pair"))
    return rows.join(masked, "pair", "left_semi").groupBy("pair").agg(F.count("*").alias("rows"))


@query("i5_resume_plan", "SELECT 'todo' AS state, p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 46)")
def _(t):
    present = t.lineitem.where("l_quantity > 46").select(F.col("l_partkey").alias("k")).distinct()
    todo, stale = rd.resumed(t.part.select(F.col("p_partkey").alias("k")), present, ["k"])
    return todo.select(F.lit("todo").alias("state"), "k").unionByName(stale.select(F.lit("stale").alias("state"), "k"))
