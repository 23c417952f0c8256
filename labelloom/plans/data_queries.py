"""Queries on manifests, labels, vectors, quality and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom import schemas, vocab
from labelloom.functions import geometry, labels, names, quality, vectors
from labelloom.functions.pixels import prepare_frames, with_hog
from labelloom.operators import coverage, domains, matrices, splits
from labelloom.operators.ranking import hash_order
from labelloom.plans import jobs, stand_ins as given
from labelloom.plans.registry import big, query, r6
from labelloom.plans.sql_views import LANDMARKS, MANIFEST, MATRIX, split
from labelloom.session import scratch_path
from labelloom.sources import images, tables, versions

# --- scans -------------------------------------------------------------------


@query(
    "label_folder_scan",
    """SELECT substr(sha256('hagrid_subset:' || rel), 1, 16) AS sample_id, lang AS gesture_label,
              '/data/' || rel AS image_path, 'folder_by_label' AS format, rel AS relative_path
       FROM (SELECT *, lang || '/' || source || '/' || doc_id || '.jpg' AS rel FROM documents) WHERE lang IN ('en', 'fr')""",
)
def label_folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images.label_folder_manifest(given.file_listing(spark, sf_dir), target_labels=["en", "fr"])
    return rows.select(
        "sample_id", "gesture_label", "image_path",
        F.col("capture_context")["format"].alias("format"),
        F.col("capture_context")["relative_path"].alias("relative_path"),
    )


@query(
    "subject_tree_scan",
    """SELECT substr(sha256('leapgestrecog:' || rel), 1, 16) AS sample_id, subject_id, gesture_label FROM (
         SELECT CASE WHEN n_chars < 500 THEN lang || '/s_' || source || '/' || doc_id || '.jpg'
                     WHEN n_chars < 1000 THEN source || '/01_' || lang || '/' || doc_id || '.jpg'
                     ELSE lang || '/' || doc_id || '.jpg' END AS rel,
                CASE WHEN n_chars < 500 THEN 's_' || source WHEN n_chars < 1000 THEN source END AS subject_id,
                CASE WHEN n_chars < 500 THEN lang WHEN n_chars < 1000 THEN '01_' || lang ELSE lang END AS gesture_label
         FROM documents)""",
)
def subject_tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.concat(F.col("doc_id").cast("string"), F.lit(".jpg"))
    relative = (
        F.when(F.col("n_chars") < 500, F.concat_ws("/", "lang", F.concat(F.lit("s_"), "source"), file))
        .when(F.col("n_chars") < 1000, F.concat_ws("/", "source", F.concat(F.lit("01_"), "lang"), file))
        .otherwise(F.concat_ws("/", "lang", file))
    )
    files = given.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/data/"), relative).alias("path"), relative.alias("relative_path")
    )
    return images.subject_tree_manifest(files).select("sample_id", "subject_id", "gesture_label")


@query(
    "annotation_scan",
    """SELECT substr(sha256('hagrid_subset:images/' || rel), 1, 16) AS sample_id, source AS subject_id,
              lang AS gesture_label, '/data/images/' || rel AS image_path, 'images/' || rel AS relative_path,
              CASE WHEN n_chars >= 500 THEN 'paper' END AS background
       FROM (SELECT *, lang || '/' || doc_id || '.jpg' AS rel FROM documents) WHERE n_chars < 5000""",
)
def annotation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of all documents; images exist for those below 5000 characters."""
    docs = given.table(spark, sf_dir, "documents").withColumn(
        "rel", F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")))
    )
    scene = F.when(F.col("n_chars") >= 500, "paper").otherwise("")
    records = docs.select(
        F.create_map(
            F.lit("file_name"), F.col("rel"), F.lit("label"), F.col("lang"),
            F.lit("user_id"), F.col("source"), F.lit("scene"), scene,
        ).alias("record"),
        F.lit("/data/annotations.json").alias("annotation_file"),
        F.col("doc_id").alias("position"),
    )
    relative = F.concat(F.lit("images/"), F.col("rel"))
    files = docs.filter("n_chars < 5000").select(
        F.concat(F.lit("/data/"), relative).alias("path"), relative.alias("relative_path")
    )
    return images.annotation_manifest(records, files, "/data").select(
        "sample_id", "subject_id", "gesture_label", "image_path",
        F.col("capture_context")["relative_path"].alias("relative_path"),
        F.col("capture_context")["background"].alias("background"),
    )


@query(
    "annotation_documents",
    """SELECT c_custkey // 5000 AS document, row_number() OVER (PARTITION BY c_custkey // 5000 ORDER BY c_custkey) - 1 AS position,
              c_name || '} "' AS label, c_mktsegment AS segment, c_nationkey::VARCHAR AS nation FROM customer""",
)
def annotation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers written as JSON documents (lists of up to 5,000 records), read back in byte ranges."""
    path = scratch_path(spark, "annotation-documents")
    rows = given.table(spark, sf_dir, "customer").withColumn("document", F.floor(F.col("c_custkey") / 5000))
    record = F.to_json(
        F.struct(
            F.concat("c_name", F.lit('} "')).alias("label"),
            F.struct(F.array(F.struct("c_mktsegment")).alias("in"), F.lit("]{").alias("mark")).alias("segment"),
            F.col("c_nationkey").alias("nation"),
        )
    )
    in_order = Window.partitionBy("document").orderBy("c_custkey")
    opening = F.when(F.row_number().over(in_order) == 1, "[").otherwise(",")
    closing = F.when(F.lead("c_custkey").over(in_order).isNull(), "]").otherwise("")
    rows.select("document", F.concat(opening, record, closing).alias("value")).write.partitionBy("document").text(path)
    records = images.read_annotations(spark, [path])
    return records.select(
        F.regexp_extract("annotation_file", r"/document=(\d+)/", 1).cast("long").alias("document"),
        "position",
        F.col("record")["label"].alias("label"),
        F.get_json_object(F.col("record")["segment"], "$.in[0].c_mktsegment").alias("segment"),
        F.col("record")["nation"].alias("nation"),
    )


@query(
    "missing_files",
    f"""WITH {MANIFEST} SELECT sample_id, image_path FROM manifest WHERE n_chars >= 2000""",
)
def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = given.table(spark, sf_dir, "documents").filter("n_chars < 2000").select(
        F.concat(
            F.lit("/data/"),
            F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".jpg"))),
        ).alias("path")
    )
    return coverage.missing_files(given.manifest(spark, sf_dir), present)


# --- sinks and readers -------------------------------------------------------


def _manifest_facts(manifest: DataFrame) -> DataFrame:
    return manifest.select(
        "sample_id", "subject_id", "gesture_label", F.col("capture_context")["relative_path"].alias("relative_path")
    )


_MANIFEST_FACTS = f"WITH {MANIFEST} SELECT sample_id, subject_id, gesture_label, relative_path FROM manifest"


@query("manifest_parquet", _MANIFEST_FACTS)
def manifest_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "manifest") + ".parquet"
    tables.write_manifest(given.manifest(spark, sf_dir), path)
    return _manifest_facts(tables.read_manifest(spark, path))


@query("manifest_csv", _MANIFEST_FACTS)
def manifest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "manifest") + ".csv"
    tables.write_manifest(given.manifest(spark, sf_dir), path)
    return _manifest_facts(tables.read_manifest(spark, path))


@query(
    "matrix_versions",
    f"""WITH {MATRIX}, every AS (SELECT 'geometric' AS feature_family, count(*) AS n FROM geo UNION ALL SELECT 'hog', count(*) FROM hog)
        SELECT 'first' AS state, feature_family, n, 0::BIGINT AS relabelled FROM every
        UNION ALL SELECT 'killed writer', feature_family, n, 0 FROM every
        UNION ALL SELECT 'newest', feature_family, n, CASE WHEN feature_family = 'geometric' THEN n ELSE 0 END FROM every""",
)
def matrix_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix table in three states: committed, with a write that was never committed, with one part replaced."""
    path = scratch_path(spark, "matrix-versions")
    read = lambda state, number=None: versions.read_version(spark, path, schemas.FEATURE_MATRIX, number).withColumn("state", F.lit(state))
    geometric, hog = (given.matrix(spark, sf_dir, family) for family in (given.GEOMETRIC, given.APPEARANCE))
    first = versions.commit_parts(geometric.unionByName(hog), path)
    states = [read("first", first)]
    changed = geometric.withColumn("gesture_label", F.concat(F.lit("new "), "gesture_label"))
    changed.write.partitionBy(*tables.MATRIX_KEYS).parquet(f"{path}/versions/never-committed")
    states.append(read("killed writer", max(versions.commit_numbers(spark, path))))
    versions.commit_parts(changed, path)
    states.append(read("newest"))
    rows = states[0].unionByName(states[1]).unionByName(states[2])
    return rows.groupBy("state", "feature_family").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("gesture_label").startswith("new ")).alias("relabelled")
    )


@query(
    "matrix_append_read",
    f"""WITH {MATRIX}
        SELECT 'geometric' AS feature_family, sample_id, len(vec)::BIGINT AS dim, round(list_sum(vec), 6) AS total,
               coalesce(confidence < 0.2, false) AS low_confidence FROM geo_valid
        UNION ALL SELECT 'hog', sample_id, 65, round(list_sum(vec), 6), false FROM hog""",
)
def matrix_append_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "matrix")
    for family in (given.GEOMETRIC, given.APPEARANCE):
        tables.append_matrix(given.matrix(spark, sf_dir, family), path)
    rows = tables.read_matrix(spark, path, dataset="embeddings", version="v1")
    return rows.select(
        "feature_family", "sample_id", big(F.size("vector_inline"), "dim"),
        r6(F.aggregate("vector_inline", F.lit(0.0), lambda acc, x: acc + x), "total"),
        quality.has_flag(F.col("quality_flags"), "low_confidence").alias("low_confidence"),
    )


@query(
    "matrix_of_split",
    f"""WITH {MATRIX}, labelled AS (SELECT sample_id, gesture_label FROM geo), {split('labelled')}
        SELECT g.sample_id, g.gesture_label FROM geo_valid g JOIN split s USING (sample_id) WHERE s.split = 'test'""",
)
def matrix_of_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition-pruned matrix read restricted to the test ids."""
    path = scratch_path(spark, "matrix")
    matrix = given.matrix(spark, sf_dir)
    tables.append_matrix(matrix, path)
    test = splits.stratified_split(matrix).filter("split = 'test'")
    rows = tables.read_matrix(spark, path, family="keypoints_only", sample_ids=test)
    return rows.select("sample_id", "gesture_label")


@query(
    "sidecar",
    f"""WITH {MATRIX}
        SELECT 'geometric' AS feature_family, count(*) AS n_samples, max(len(vec))::BIGINT AS vector_dim FROM geo
        UNION ALL SELECT 'hog', count(*), max(len(vec))::BIGINT FROM hog""",
)
def sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = given.matrix(spark, sf_dir).unionByName(given.matrix(spark, sf_dir, given.APPEARANCE))
    path = scratch_path(spark, "sidecar")
    tables.write_sidecar(both, path, {"feature_version": "v1"})
    parts = [tables.read_sidecar(spark, path, "embeddings", f) for f in ("keypoints_only", "hog_only")]
    return parts[0].unionByName(parts[1]).select("feature_family", "n_samples", big("vector_dim"))


@query(
    "config_fingerprint",
    """SELECT o_orderstatus, count(*) AS n,
              substr(sha256('{"n": ' || count(*) || ', "status": "' || o_orderstatus || '"}'), 1, 16) AS fingerprint
       FROM orders GROUP BY 1""",
)
def config_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of one configuration per order status, by the library's function."""
    counted = given.table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))

    @F.udf("string")
    def fingerprint(n: int, status: str) -> str:
        return tables.config_fingerprint({"status": status, "n": n, "_meta": "left out"})

    return counted.withColumn("fingerprint", fingerprint("n", "o_orderstatus"))


# --- ids and labels ----------------------------------------------------------


@query("manifest_ids", f"WITH {MANIFEST} SELECT doc_id, sample_id FROM manifest")
def manifest_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given.manifest(spark, sf_dir).select(
        F.regexp_extract("image_path", r"(\d+)\.jpg$", 1).cast("bigint").alias("doc_id"), "sample_id"
    )


@query(
    "label_normalize",
    """SELECT o_orderkey, replace(replace(lower(trim(o_orderpriority)), '-', '_'), ' ', '_') AS label_key,
              CASE o_orderpriority WHEN '3-MEDIUM' THEN '3-MEDIUM' WHEN '1-URGENT' THEN 'stop'
                   WHEN '2-HIGH' THEN 'Two High' WHEN '5-LOW' THEN '5_low' ELSE 'not specified' END AS gesture_label
       FROM orders""",
)
def label_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact vocabulary, alias, folded vocabulary and own key, one priority each."""
    raw = F.col("o_orderpriority")
    label = labels.normalize_label(
        raw,
        "orders",
        label_aliases={"1 URGENT": "stop", "3-medium": "never", "2-high": "Two High", "4-not-specified": "not specified"},
        canonical_labels=["3-MEDIUM", "Four", "stop"],
    )
    return given.table(spark, sf_dir, "orders").select(
        "o_orderkey", labels.label_key(raw).alias("label_key"), label.alias("gesture_label")
    )


_TREE_CASE = """CASE o_orderpriority WHEN '1-URGENT' THEN '01_palm' WHEN '2-HIGH' THEN '05_thumb'
    WHEN '3-MEDIUM' THEN '08_palm_moved' WHEN '4-NOT SPECIFIED' THEN '02_l' ELSE '09_c' END"""


@query(
    "label_repair",
    f"""SELECT o_orderkey,
               CASE o_orderstatus WHEN 'F' THEN {_TREE_CASE} WHEN 'O' THEN {_TREE_CASE} ELSE 'thumb_up' END AS raw_gesture_label,
               CASE WHEN o_orderstatus = 'P' THEN 'like' ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'stop'
                 WHEN '2-HIGH' THEN 'like' WHEN '3-MEDIUM' THEN 'palm' WHEN '4-NOT SPECIFIED' THEN 'thumb_index'
                 ELSE 'grip' END END AS gesture_label
        FROM orders""",
)
def label_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels recovered from relative paths (status F), image paths (O) or kept (P)."""
    priority = {"1-URGENT": "01_palm", "2-HIGH": "05_thumb", "3-MEDIUM": "08_palm_moved", "4-NOT SPECIFIED": "02_l"}
    pairs = [F.lit(x) for kv in priority.items() for x in kv]
    folder = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("o_orderpriority")), F.lit("09_c"))
    number = F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0")
    status = F.col("o_orderstatus")
    rows = given.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.lit(vocab.TREE_DATASET).alias("dataset_name"),
        F.when(status == "P", "thumb_up").otherwise(number).alias("gesture_label"),
        F.when(status == "F", F.create_map(F.lit("relative_path"), F.concat(F.lit("\\"), folder, F.lit("\\a.jpg"))))
        .otherwise(F.create_map(F.lit("relative_path"), F.lit("a.jpg")))
        .alias("capture_context"),
        F.concat(F.lit("/data/"), number, F.lit("/"), folder, F.lit("/a.jpg")).alias("image_path"),
    )
    return matrices.repaired_labels(rows).select("o_orderkey", "raw_gesture_label", "gesture_label")


@query(
    "context_parse",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'broken ' || props END AS raw,
              CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE (props::JSON ->> 'k') END AS k,
              CASE event_type WHEN 'signup' THEN 0 ELSE 1 END::BIGINT AS n_keys
       FROM events""",
)
def context_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts from JSON; error events carry broken text and sign-ups none."""
    kind = F.col("event_type")
    text = (
        F.when(kind == "error", F.concat(F.lit("broken "), "props"))
        .when(kind == "signup", F.lit(" "))
        .otherwise(F.col("props"))
    )
    context = labels.parse_context(text)
    return given.table(spark, sf_dir, "events").select("event_id", context.alias("c")).select(
        "event_id",
        F.try_element_at("c", F.lit("raw")).alias("raw"),
        F.try_element_at("c", F.lit("k")).alias("k"),
        big(F.size("c"), "n_keys"),
    )


@query(
    "flags_json",
    f"""WITH {MATRIX} SELECT sample_id, failed AS detection_failed, coalesce(confidence < 0.2, false) AS low_confidence,
        (CASE WHEN failed THEN 1 ELSE 0 END + CASE WHEN confidence < 0.2 THEN 1 ELSE 0 END)::BIGINT AS n_flags FROM geo""",
)
def flags_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags to JSON text and back."""
    text = quality.flags_to_json(F.col("quality_flags"))
    rows = given.matrix(spark, sf_dir).select("sample_id", quality.flags_from_json(text).alias("f"))
    flag = lambda name: quality.has_flag(F.col("f"), name).alias(name)
    return rows.select("sample_id", flag("detection_failed"), flag("low_confidence"), big(F.size("f"), "n_flags"))


@query("observed_labels", "SELECT DISTINCT event_type AS gesture_label FROM events WHERE event_type <> ''")
def observed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = given.table(spark, sf_dir, "events").withColumnRenamed("event_type", "gesture_label")
    return coverage.observed_labels(events)


@query(
    "label_coverage",
    """SELECT coalesce(d.gesture_label, r.gesture_label) AS gesture_label, coalesce(n, 0) AS n,
              CASE WHEN d.gesture_label IS NULL THEN 'missing_reference'
                   WHEN r.gesture_label IS NULL THEN 'outside_reference' ELSE 'aligned' END AS standing
       FROM (SELECT lang AS gesture_label, count(*) AS n FROM documents GROUP BY 1) d
       FULL JOIN (SELECT unnest(['en', 'fr', 'it']) AS gesture_label) r ON r.gesture_label = d.gesture_label""",
)
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.label_coverage(given.manifest(spark, sf_dir), ["en", "fr", "it"])


@query(
    "aligned_ratio",
    "SELECT count(*) AS total_samples, avg(CASE WHEN lang IN ('en', 'fr') THEN 1.0 ELSE 0.0 END) AS aligned_with_reference_ratio FROM documents",
)
def aligned_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.aligned_ratio(label_coverage(spark, sf_dir))


@query(
    "label_overlap",
    """SELECT gesture_label, CASE WHEN min(side) <> max(side) THEN 'shared' WHEN min(side) = 1 THEN 'left_only'
                             ELSE 'right_only' END AS occurrence
       FROM (SELECT DISTINCT n_name AS gesture_label, 1 AS side FROM nation JOIN supplier ON s_nationkey = n_nationkey
             UNION ALL SELECT DISTINCT c_mktsegment, 1 FROM customer
             UNION ALL SELECT DISTINCT n_name, 2 FROM nation JOIN customer ON c_nationkey = n_nationkey) GROUP BY 1""",
)
def label_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of suppliers, with the market segments, against nations of customers."""
    nation = given.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("gesture_label"))
    supplier, customer = given.table(spark, sf_dir, "supplier"), given.table(spark, sf_dir, "customer")
    of = lambda df, key: df.join(nation, F.col(key) == F.col("n_nationkey")).select("gesture_label")
    left = of(supplier, "s_nationkey").unionByName(customer.select(F.col("c_mktsegment").alias("gesture_label")))
    return domains.label_overlap(left, of(customer, "c_nationkey"))


@query(
    "dataset_summary",
    f"""WITH {MANIFEST}
        SELECT 'total' AS section, '' AS key, count(*) AS n FROM manifest
        UNION ALL SELECT 'class', gesture_label, count(*) FROM manifest GROUP BY 2
        UNION ALL SELECT 'subject', subject_id, count(*) FROM manifest GROUP BY 2
        UNION ALL SELECT 'duplicate_sample_id', sample_id, count(*) FROM manifest GROUP BY 2 HAVING count(*) > 1""",
)
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.dataset_summary(given.manifest(spark, sf_dir))


@query(
    "duplicate_ids",
    "SELECT l_orderkey AS sample_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = given.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"))
    return coverage.duplicate_ids(lines)


@query(
    "manifest_job",
    """SELECT CASE lang WHEN 'en' THEN 'palm' WHEN 'de' THEN 'Fist' ELSE lang END AS gesture_label, count(*) AS n,
              CASE WHEN lang IN ('en', 'de') THEN 'aligned' ELSE 'outside_reference' END AS standing
       FROM documents GROUP BY lang
       UNION ALL SELECT 'like', 0, 'missing_reference'""",
)
def manifest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = {"label_aliases": {"EN": "palm", "de": "Fist"}, "label_vocabulary": ["palm", "Fist", "like"]}
    return jobs.manifest_tables(given.manifest(spark, sf_dir), config)["label_coverage"]


# --- vectors and geometry ----------------------------------------------------


def _long(df: DataFrame, column: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode_outer(column).alias("pos", "v")).select(*keys, big("pos"), r6("v", "value"))


@query(
    "landmark_normalize",
    f"""WITH {LANDMARKS}
        SELECT sample_id, i AS pos, round(CASE WHEN i % 2 = 0 THEN nx[i // 2 + 1] ELSE ny[i // 2 + 1] END, 6) AS value
        FROM norm, range(42) t(i)""",
)
def landmark_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given.landmarks(spark, sf_dir).filter("landmarks is not null")
    points = geometry.normalize_landmarks(F.col("landmarks"))
    return _long(rows.select("sample_id", geometry.flat_points(points).alias("p")), "p", "sample_id")


_PAIRS = """(SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS pos
             FROM range(1, 22) a(i), range(1, 22) b(j) WHERE i < j)"""
_ANGLES = """(SELECT * FROM (VALUES (0, 1, 6, 10), (1, 1, 10, 14), (2, 1, 14, 18), (3, 6, 7, 9),
              (4, 10, 11, 13), (5, 14, 15, 17), (6, 18, 19, 21), (7, 1, 2, 6)) t(pos, a, b, c))"""
_ANGLE_SQL = """CASE WHEN sqrt(ux*ux + uy*uy) * sqrt(wx*wx + wy*wy) < 1e-8 THEN 0
    ELSE acos(greatest(-1.0, least(1.0, (ux*wx + uy*wy) / (sqrt(ux*ux + uy*uy) * sqrt(wx*wx + wy*wy))))) END"""
_ANGLE_ROWS = f"""(SELECT sample_id, pos, {_ANGLE_SQL} AS angle FROM (
    SELECT sample_id, pos, nx[a] - nx[b] AS ux, ny[a] - ny[b] AS uy, nx[c] - nx[b] AS wx, ny[c] - ny[b] AS wy
    FROM norm, {_ANGLES}))"""


@query(
    "pairwise_distances",
    f"""WITH {LANDMARKS}
        SELECT sample_id, pos, round(sqrt(power(nx[i] - nx[j], 2) + power(ny[i] - ny[j], 2)), 6) AS value
        FROM norm, {_PAIRS}""",
)
def pairwise_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given.landmarks(spark, sf_dir).filter("landmarks is not null")
    distances = geometry.let(geometry.normalize_landmarks(F.col("landmarks")), geometry.pairwise_distances)
    return _long(rows.select("sample_id", distances.alias("d")), "d", "sample_id")


@query("joint_angles", f"WITH {LANDMARKS} SELECT sample_id, pos::BIGINT AS pos, round(angle, 6) AS value FROM {_ANGLE_ROWS}")
def joint_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given.landmarks(spark, sf_dir).filter("landmarks is not null")
    angles = geometry.let(geometry.normalize_landmarks(F.col("landmarks")), geometry.joint_angles)
    return _long(rows.select("sample_id", angles.alias("a")), "a", "sample_id")


@query(
    "geometric_vector",
    f"""WITH {LANDMARKS}, parts AS (
          SELECT sample_id, i AS pos, CASE WHEN i % 2 = 0 THEN nx[i // 2 + 1] ELSE ny[i // 2 + 1] END AS v FROM norm, range(42) t(i)
          UNION ALL SELECT sample_id, 42 + pos, sqrt(power(nx[i] - nx[j], 2) + power(ny[i] - ny[j], 2)) FROM norm, {_PAIRS}
          UNION ALL SELECT sample_id, 252 + pos, angle FROM {_ANGLE_ROWS})
        SELECT sample_id, count(*) AS dim, round(sum(v), 6) AS total, round(sum(v * v), 6) AS squares,
               round(sum(v * pos), 4) AS weighted FROM parts GROUP BY 1""",
)
def geometric_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and three position-sensitive sums of the 260-value vector."""
    rows = geometry.with_geometric_vector(given.landmarks(spark, sf_dir).filter("landmarks is not null"))
    add = lambda f: F.aggregate(F.transform("vector_inline", f), F.lit(0.0), lambda acc, x: acc + x)
    return rows.select(
        "sample_id", big(F.size("vector_inline"), "dim"),
        r6(add(lambda x: x), "total"), r6(add(lambda x: x * x), "squares"),
        F.round(add(lambda x, i: x * i), 4).alias("weighted"),
    )


@query(
    "raw_keypoints",
    f"""WITH {LANDMARKS} SELECT sample_id, i AS pos,
        round(CASE i % 3 WHEN 0 THEN x[i // 3 + 1] WHEN 1 THEN y[i // 3 + 1] ELSE z[i // 3 + 1] END, 6) AS value
        FROM box, range(63) t(i)""",
)
def raw_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given.landmarks(spark, sf_dir).filter("landmarks is not null")
    return _long(rows.select("sample_id", geometry.raw_keypoints(F.col("landmarks")).alias("p")), "p", "sample_id")


@query(
    "pixel_landmarks",
    f"""WITH {LANDMARKS} SELECT sample_id, i AS pos,
        round(CASE i % 3 WHEN 0 THEN x[i // 3 + 1] * 640 WHEN 1 THEN y[i // 3 + 1] * 480 ELSE z[i // 3 + 1] END, 6) AS value
        FROM box, range(63) t(i)""",
)
def pixel_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given.landmarks(spark, sf_dir).filter("landmarks is not null")
    pixels = F.flatten(geometry.to_pixels(F.col("landmarks"), F.col("width"), F.col("height")))
    return _long(rows.select("sample_id", pixels.alias("p")), "p", "sample_id")


@query(
    "crop_boxes",
    f"""WITH {LANDMARKS}, e AS (
          SELECT sample_id, seen, list_min(px) AS xa, list_max(px) AS xb, list_min(py) AS ya, list_max(py) AS yb FROM (
            SELECT sample_id, seen, list_transform(x, lambda a: (a + 0.5) * 640) AS px,
                   list_transform(y, lambda b: (b + 0.5) * 480) AS py FROM lm)),
        c AS (SELECT sample_id, seen,
                CASE WHEN seen THEN trunc(greatest(0.0, xa - (xb - xa) * 0.15))::INT ELSE 80 END AS x0,
                CASE WHEN seen THEN trunc(greatest(0.0, ya - (yb - ya) * 0.15))::INT ELSE 0 END AS y0,
                CASE WHEN seen THEN trunc(least(640.0, xb + (xb - xa) * 0.15))::INT ELSE 560 END AS x1,
                CASE WHEN seen THEN trunc(least(480.0, yb + (yb - ya) * 0.15))::INT ELSE 480 END AS y1 FROM e)
        SELECT sample_id, seen AS from_landmarks, CASE WHEN x1 <= x0 OR y1 <= y0 THEN 0 ELSE x0 END::BIGINT AS x0,
               CASE WHEN x1 <= x0 OR y1 <= y0 THEN 0 ELSE y0 END::BIGINT AS y0,
               CASE WHEN x1 <= x0 OR y1 <= y0 THEN 640 ELSE x1 END::BIGINT AS x1,
               CASE WHEN x1 <= x0 OR y1 <= y0 THEN 480 ELSE y1 END::BIGINT AS y1 FROM c""",
)
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop boxes of landmarks around the image centre; unseen hands get the square."""
    moved = F.transform(
        "landmarks", lambda p: F.array((p[0] + 0.5) * F.col("width"), (p[1] + 0.5) * F.col("height"), p[2])
    )
    rows = given.landmarks(spark, sf_dir).withColumn("landmarks", moved)
    box = geometry.crop_box(F.col("landmarks"), F.col("width"), F.col("height"))
    return rows.select("sample_id", box.alias("b")).select(
        "sample_id", "b.from_landmarks", *[big(F.col(f"b.{c}"), c) for c in ("x0", "y0", "x1", "y1")]
    )


@query(
    "block_reshape",
    """SELECT vec_id::VARCHAR AS sample_id, b AS block, i AS pos, round(embedding[b * 4 + i + 1]::DOUBLE, 6) AS value,
              round(embedding[i * 4 + b % 4 + 1]::DOUBLE, 6) AS channel_value
       FROM embeddings, range(16) t(b), range(4) u(i)""",
)
def block_reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 values as a 4 x 4 grid of 4: block sequence, and channels-first maps."""
    grid = (4, 4, 4)
    v = F.col("vector_inline")
    rows = given.vectors(spark, sf_dir).select(
        "sample_id", vectors.block_sequence(v, grid).alias("s"), vectors.block_channels(v, grid).alias("c")
    )
    blocks = rows.select("sample_id", "c", F.posexplode("s").alias("block", "values")).select(
        "sample_id", "c", "block", F.posexplode("values").alias("pos", "value")
    )
    # Channel b % 4 at grid cell (pos // 4 ... ) holds value pos * 4 + channel.
    cell = F.get(F.get(F.get("c", F.col("block") % 4), F.floor(F.col("pos") / 4).cast("int")), F.col("pos") % 4)
    return blocks.select("sample_id", big("block"), big("pos"), r6("value"), r6(cell, "channel_value"))


@query(
    "vector_dims",
    "SELECT vec_id::VARCHAR AS sample_id, len(embedding)::BIGINT AS dim, 'hybrid' AS layout, 28::BIGINT AS flat FROM embeddings",
)
def vector_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector accessor with its length, and the layout of 64 = 28 + 3*3*4 values."""
    layout, flat = vectors.feature_layout(64, (3, 3, 4), head=28)
    v = vectors.vector(F.col("vector_inline"))
    return given.vectors(spark, sf_dir).select(
        "sample_id", big(F.size(v), "dim"), F.lit(layout).alias("layout"), big(F.lit(flat), "flat")
    )


@query(
    "softmax_argmax",
    """WITH e AS (SELECT vec_id::VARCHAR AS sample_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
       p AS (SELECT sample_id, v, list_transform(v, lambda x: exp(x - list_max(v))) AS w FROM e)
       SELECT sample_id, list_position(v, list_max(v))::BIGINT AS best, round(1 / list_sum(w), 6) AS confidence FROM p""",
)
def softmax_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given.vectors(spark, sf_dir).select("sample_id", F.col("vector_inline").alias("s"))
    share = vectors.as_probabilities(F.col("s"))
    return rows.select("sample_id", big(vectors.argmax(F.col("s")), "best"), r6(F.array_max(share), "confidence"))


@query(
    "hybrid_blocks",
    f"""WITH {MATRIX} SELECT h.sample_id, i AS pos, round(CASE WHEN i < 64 THEN g.v[i + 1] ELSE h.vec[i - 63] END, 6) AS value
        FROM emb g JOIN hog h USING (sample_id), range(129) t(i)""",
)
def hybrid_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered concatenation of two blocks of the same row."""
    v = F.col("vector_inline")
    blocks = {"hog": F.concat(F.transform(v, lambda x: x * x), F.array(F.lit(1.0))), "geometric": v}
    rows = given.vectors(spark, sf_dir).select(
        "sample_id", vectors.concat_blocks(blocks, ("geometric", "hog")).alias("b")
    )
    return _long(rows, "b", "sample_id")


_IMAGE_WIDTH = 64


def text_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as grey images: the UTF-8 bytes of the whole text, 64 per row."""
    data = F.encode("text", "UTF-8")
    height = F.greatest(F.lit(1), F.ceil(F.length(data) / _IMAGE_WIDTH)).cast("int")
    return (
        given.table(spark, sf_dir, "documents")
        .select(F.col("doc_id").alias("sample_id"), "lang", data.alias("data"), height.alias("height"))
        .withColumn("data", F.rpad("data", F.col("height") * _IMAGE_WIDTH, F.lit(bytes(1))))
        .withColumn("width", F.lit(_IMAGE_WIDTH))
        .withColumn("nChannels", F.lit(1))
    )


@query("hog_features", "SELECT doc_id AS sample_id, lang, 1764::BIGINT AS dim, true AS in_range, true AS blocks_normal FROM documents")
def hog_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts on the gradient descriptors of all text images: length, range, block norms of 0 or about 1."""
    rows = with_hog(text_images(spark, sf_dir))
    v = F.col("vector_inline")
    squares = F.transform(F.sequence(F.lit(0), F.lit(48)), lambda i: F.aggregate(F.slice(v, i * 36 + 1, 36), F.lit(0.0), lambda t, x: t + x * x))
    return rows.select(
        "sample_id", "lang", big(F.size(v), "dim"), (F.array_min(v).between(0, 1) & F.array_max(v).between(0, 1)).alias("in_range"),
        F.forall(squares, lambda q: (q < 1e-6) | q.between(0.9, 1.0001)).alias("blocks_normal"),
    )


@query(
    "frame_prepare",
    """SELECT doc_id AS sample_id, greatest(1, ceil(strlen(text) / 64.0))::BIGINT AS height, 32::BIGINT AS width,
              3::BIGINT AS channels, 96 * greatest(1, ceil(strlen(text) / 64.0))::BIGINT AS n_bytes FROM documents""",
)
def frame_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text images as three channels, left half."""
    frames = prepare_frames(text_images(spark, sf_dir), region="left_half")
    return frames.select(
        "sample_id", big("height"), big("width"), big("nChannels", "channels"), big(F.length("data"), "n_bytes")
    )


# --- extraction and quality --------------------------------------------------


@query(
    "feature_records",
    f"""WITH {MATRIX} SELECT sample_id, 'geometric' AS feature_family, 'v2' AS feature_version, failed AS detection_failed,
        coalesce(confidence < 0.2, false) AS low_confidence,
        true AS extraction_ok FROM geo""",
)
def feature_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records rebuilt from bare rows with failure conditions folded into flags."""
    rows = given.matrix(spark, sf_dir).drop("extraction_ok", "source_families")
    failed = quality.has_flag(F.col("quality_flags"), "detection_failed")
    records = matrices.feature_records(
        rows.withColumn("quality_flags", F.map_filter("quality_flags", lambda k, _: k != "detection_failed")),
        "geometric",
        version="v2",
        low_confidence=F.col("confidence") < 0.1,
    )
    again = rows.select("sample_id", failed.alias("_failed"))
    with_failure = records.join(again, "sample_id").withColumn(
        "quality_flags",
        quality.merge_flags(F.col("quality_flags"), quality.flag_when("detection_failed", F.col("_failed"))),
    )
    flag = lambda name: quality.has_flag(F.col("quality_flags"), name).alias(name)
    return with_failure.select(
        "sample_id", "feature_family", "feature_version", flag("detection_failed"), flag("low_confidence"), "extraction_ok"
    )


@query(
    "extraction",
    f"""WITH {LANDMARKS}, d AS (
          SELECT sample_id, sqrt(power((nx[1] - nx[21]) , 2) + power((ny[1] - ny[21]), 2)) AS reach FROM (
            SELECT sample_id, list_transform(x, lambda a: (a - x[1]) * 640 / diag) AS nx,
                   list_transform(y, lambda b: (b - y[1]) * 480 / diag) AS ny FROM (
              SELECT *, sqrt(power((list_max(x) - list_min(x)) * 640, 2) + power((list_max(y) - list_min(y)) * 480, 2)) AS diag
              FROM lm WHERE seen)))
        SELECT lm.sample_id, seen AS extraction_ok, NOT seen AS detection_failed,
               seen AND confidence < 0.05 AS low_confidence, 260::BIGINT AS dim, round(coalesce(reach, 0), 6) AS reach
        FROM lm LEFT JOIN d USING (sample_id)""",
)
def extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometric extraction with failure flags and zero vectors (one distance shown)."""
    rows = jobs.extract_features(given.landmarks(spark, sf_dir), "geometric", min_confidence=0.05)
    flag = lambda name: quality.has_flag(F.col("quality_flags"), name).alias(name)
    return rows.select(
        "sample_id", "extraction_ok", flag("detection_failed"), flag("low_confidence"),
        big(F.size("vector_inline"), "dim"), r6(F.get("vector_inline", F.lit(42 + 19)), "reach"),
    )


@query(
    "extraction_raw_and_missing",
    f"""WITH {LANDMARKS} SELECT sample_id, seen AND confidence < 0.18 AS extraction_ok, confidence >= 0.18 AS missing_image,
        NOT seen AND confidence < 0.18 AS detection_failed, 63::BIGINT AS dim FROM lm""",
)
def extraction_raw_and_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw keypoints; rows of high last component stand for unreadable images."""
    rows = given.landmarks(spark, sf_dir).withColumn("height", F.when(F.col("confidence") < 0.18, F.col("height")))
    records = jobs.extract_features(rows, "keypoints_raw")
    flag = lambda name: quality.has_flag(F.col("quality_flags"), name).alias(name)
    return records.select(
        "sample_id", "extraction_ok", flag("missing_image"), flag("detection_failed"), big(F.size("vector_inline"), "dim")
    )


@query(
    "quality_flags",
    f"""WITH {MATRIX} SELECT sample_id, coalesce(confidence < 0.3, false) AS low_confidence,
        len(list_filter(v, lambda x: x > 0)) < 28 AS insufficient_landmarks, failed AS detection_failed
        FROM geo JOIN emb USING (sample_id)""",
)
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given.matrix(spark, sf_dir).join(
        given.vectors(spark, sf_dir).select("sample_id", F.size(F.filter("vector_inline", lambda x: x > 0)).alias("visible")),
        "sample_id",
    )
    flags = quality.apply_quality_flags(F.col("quality_flags"), F.col("confidence"), 0.3, F.col("visible"), 28)
    flag = lambda name: quality.has_flag(F.col("f"), name).alias(name)
    return rows.select("sample_id", flags.alias("f")).select(
        "sample_id", flag("low_confidence"), flag("insufficient_landmarks"), flag("detection_failed")
    )


@query("zero_vectors", f"WITH {MATRIX} SELECT sample_id FROM geo WHERE vec IS NULL OR failed")
def zero_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given.matrix(spark, sf_dir).filter(vectors.is_zero_vector(F.col("vector_inline"))).select("sample_id")


@query(
    "validity_counts",
    f"""WITH {MATRIX} SELECT 'geometric' AS feature_family, (SELECT count(*) FROM geo_valid) AS kept,
               count(*) - (SELECT count(*) FROM geo_valid) AS dropped FROM geo
        UNION ALL SELECT 'hog', count(*), 0 FROM hog""",
)
def validity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = given.matrix(spark, sf_dir).unionByName(given.matrix(spark, sf_dir, given.APPEARANCE))
    return matrices.validity_counts(both)


@query("family_filter", "SELECT 'geometric' AS feature_family, count(*) AS n FROM embeddings")
def family_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one family by its experiment name; an unknown family keeps all."""
    both = given.matrix(spark, sf_dir).unionByName(given.matrix(spark, sf_dir, given.APPEARANCE))
    rows = matrices.rows_of_family(both, "keypoints_only")
    return matrices.rows_of_family(rows, "hog_only").groupBy("feature_family").agg(F.count(F.lit(1)).alias("n"))


@query("label_filter", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = given.table(spark, sf_dir, "events")
    return splits.filter_labels(events, ["Click", "VIEW"], "event_type", fold_case=True).select("event_id", "event_type")


_COVERAGE = f"""WITH {MATRIX}, part AS (
  SELECT gesture_label, count(*) AS total_samples,
         count(*) FILTER (ok AND vec IS NOT NULL) AS successful_extractions,
         count(*) FILTER (failed) AS detection_failures, count(*) FILTER (confidence < 0.2) AS low_confidence_count,
         count(*) FILTER (vec IS NULL) AS missing_vectors FROM geo GROUP BY 1)"""


@query(
    "coverage_by_label",
    f"""{_COVERAGE} SELECT gesture_label, total_samples, successful_extractions,
        total_samples - successful_extractions AS failed_extractions,
        round(successful_extractions::DOUBLE / total_samples, 6) AS success_rate FROM part""",
)
def coverage_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coverage.coverage_by_label(coverage.partial_coverage(given.matrix(spark, sf_dir)))
    return rows.withColumn("success_rate", r6("success_rate"))


@query(
    "coverage_merge",
    f"""{_COVERAGE} SELECT sum(total_samples)::BIGINT AS total_samples, sum(successful_extractions)::BIGINT AS successful_extractions,
        sum(detection_failures)::BIGINT AS detection_failures, sum(low_confidence_count)::BIGINT AS low_confidence_count,
        sum(missing_vectors)::BIGINT AS missing_vectors,
        (sum(total_samples) - sum(successful_extractions))::BIGINT AS failed_extractions,
        round(sum(successful_extractions)::DOUBLE / sum(total_samples), 6) AS success_rate FROM part""",
)
def coverage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial coverage of two parts of the matrix, written, merged and totalled."""
    matrix = given.matrix(spark, sf_dir)
    first = F.coalesce(F.col("confidence") < 0.4, F.lit(False))
    path = scratch_path(spark, "coverage")
    for part in (matrix.filter(first), matrix.filter(~first)):
        coverage.partial_coverage(part).write.mode("append").parquet(path)
    merged = coverage.merge_coverage(spark.read.parquet(path))
    return coverage.overall_coverage(merged).withColumn("success_rate", r6("success_rate"))


@query(
    "coverage_thresholds",
    f"""{_COVERAGE} SELECT 'min_samples' AS rule, 50.0::DOUBLE AS threshold, gesture_label, total_samples, successful_extractions,
          round(successful_extractions::DOUBLE / total_samples, 6) AS success_rate FROM part WHERE total_samples < 50
        UNION ALL SELECT 'success_rate', 0.95, gesture_label, total_samples, successful_extractions,
          round(successful_extractions::DOUBLE / total_samples, 6) FROM part
        WHERE successful_extractions::DOUBLE / total_samples < 0.95""",
)
def coverage_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    partial = coverage.partial_coverage(given.matrix(spark, sf_dir))
    return coverage.coverage_violations(partial, 50, 0.95).withColumn("success_rate", r6("success_rate"))


@query(
    "flag_counts",
    f"""WITH {MATRIX} SELECT * FROM (SELECT 'detection_failed' AS flag, count(*) FILTER (failed) AS n FROM geo
        UNION ALL SELECT 'low_confidence', count(*) FILTER (confidence < 0.2) FROM geo) WHERE n > 0""",
)
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.flag_counts(given.matrix(spark, sf_dir))


@query(
    "low_confidence_ids",
    f"WITH {MATRIX} SELECT sample_id, round(confidence, 6) AS confidence FROM geo WHERE confidence < 0.25",
)
def low_confidence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coverage.low_confidence_ids(given.matrix(spark, sf_dir), 0.25)
    return rows.select("sample_id", r6("confidence"))


@query("feature_quality_report", f"""{_COVERAGE} SELECT 'total' AS fact, '' AS key, sum(total_samples)::BIGINT AS n FROM part
        UNION ALL SELECT 'failed', '', (sum(total_samples) - sum(successful_extractions))::BIGINT FROM part
        UNION ALL SELECT 'flag', 'detection_failed', sum(detection_failures)::BIGINT FROM part
        UNION ALL SELECT 'flag', 'low_confidence', sum(low_confidence_count)::BIGINT FROM part
        UNION ALL SELECT 'low_confidence_ids', '', count(*) FROM geo WHERE confidence < 0.25""")
def feature_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = jobs.quality_tables(given.matrix(spark, sf_dir), min_confidence=0.25)
    fact = lambda name, n: F.struct(F.lit(name).alias("fact"), F.lit("").alias("key"), n.alias("n"))
    overall = reports["overall"].select(
        F.inline(F.array(fact("total", F.col("total_samples")), fact("failed", F.col("failed_extractions"))))
    )
    flags = reports["flags"].select(F.lit("flag").alias("fact"), F.col("flag").alias("key"), "n")
    low = reports["low_confidence"].agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("low_confidence_ids").alias("fact"), F.lit("").alias("key"), "n"
    )
    return overall.unionByName(flags).unionByName(low)


# --- joins -------------------------------------------------------------------


@query(
    "hybrid_join",
    f"""WITH {MATRIX} SELECT g.sample_id, g.gesture_label, len(list_concat(g.vec, h.vec))::BIGINT AS dim,
        round(list_sum(list_concat(g.vec, h.vec)), 6) AS total, round(least(coalesce(g.confidence, 1), coalesce(h.confidence, 1)), 6) AS confidence,
        coalesce(g.confidence < 0.2, false) AS low_confidence, true AS extraction_ok
        FROM geo_valid g JOIN hog h USING (sample_id)""",
)
def hybrid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrices.hybrid_join(given.matrix(spark, sf_dir), given.matrix(spark, sf_dir, given.APPEARANCE))
    return rows.select(
        "sample_id", "gesture_label", big(F.size("vector_inline"), "dim"),
        r6(F.aggregate("vector_inline", F.lit(0.0), lambda acc, x: acc + x), "total"),
        r6("confidence"), quality.has_flag(F.col("quality_flags"), "low_confidence").alias("low_confidence"),
        "extraction_ok",
    )


@query(
    "hybrid_guards",
    f"""WITH {MATRIX}, k AS (SELECT sample_id, gesture_label FROM geo_valid UNION ALL
                             SELECT sample_id, gesture_label FROM geo_valid WHERE confidence > 0.9),
        h AS (SELECT sample_id, CASE WHEN confidence > 0.8 THEN 'x' ELSE gesture_label END AS gesture_label FROM hog WHERE NOT confidence < 0.05),
        i AS (SELECT coalesce(a.sample_id, b.sample_id) AS id, coalesce(a.n, 0) AS k, coalesce(b.n, 0) AS h, a.l AS kl, b.l AS hl
              FROM (SELECT sample_id, count(*) AS n, max(gesture_label) AS l FROM k GROUP BY 1) a
              FULL JOIN (SELECT sample_id, count(*) AS n, max(gesture_label) AS l FROM h GROUP BY 1) b USING (sample_id))
        SELECT count(*) FILTER (k > 1) AS duplicate_keypoint_ids, count(*) FILTER (h > 1) AS duplicate_hog_ids,
               count(*) FILTER (k > 0 AND h = 0) AS missing_in_hog,
               count(*) FILTER (k > 0 AND h > 0 AND kl <> hl) AS label_mismatches,
               count(*) FILTER (k = 0 AND h > 0) AS skipped_without_keypoints FROM i""",
)
def hybrid_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards on tables with repeated, missing and relabelled rows."""
    keypoints = matrices.exclude_invalid(given.matrix(spark, sf_dir))
    doubled = keypoints.unionByName(keypoints.filter("confidence > 0.9"))
    hog = given.matrix(spark, sf_dir, given.APPEARANCE).filter("not confidence < 0.05")
    relabelled = hog.withColumn(
        "gesture_label", F.when(F.col("confidence") > 0.8, "x").otherwise(F.col("gesture_label"))
    )
    return matrices.hybrid_guards(doubled, relabelled)


@query(
    "label_sync",
    """SELECT o.o_orderkey::VARCHAR AS sample_id,
              coalesce(CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'palm' ELSE lower(c.c_mktsegment) END, o.o_orderpriority) AS gesture_label,
              c.c_custkey IS NOT NULL AS updated
       FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_orderkey""",
)
def label_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order labels overwritten by those of customers with the same number."""
    matrix = given.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_orderpriority").alias("gesture_label")
    )
    segment = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "10_down").otherwise(F.col("c_mktsegment"))
    manifest = given.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("sample_id"),
        F.lit(vocab.TREE_DATASET).alias("dataset_name"),
        segment.alias("gesture_label"),
    )
    return matrices.sync_labels(matrix, manifest)


# --- splits ------------------------------------------------------------------


@query("stratified_split", f"WITH {MANIFEST}, {split('manifest')} SELECT sample_id, gesture_label, split FROM split")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_split(given.manifest(spark, sf_dir)).select("sample_id", "gesture_label", "split")


@query(
    "split_distribution",
    f"WITH {MANIFEST}, {split('manifest')} SELECT split, gesture_label, count(*) AS n FROM split GROUP BY 1, 2",
)
def split_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = given.manifest(spark, sf_dir)
    return splits.split_distribution(manifest, splits.stratified_split(manifest))


_FOLDS = f"""WITH {MANIFEST}, {split('manifest')},
tr AS (SELECT sample_id, gesture_label FROM split WHERE split = 'train'),
sizes AS (SELECT gesture_label, count(*) AS n FROM tr GROUP BY 1),
st AS (SELECT gesture_label, n, coalesce(sum(n) OVER (ORDER BY gesture_label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s,
              (SELECT least(5, count(*), sum(n))::BIGINT FROM sizes) AS k FROM sizes),
cut AS (SELECT gesture_label, f, sum((n + ((s - f - 1) % k + k) % k) // k) OVER (PARTITION BY gesture_label ORDER BY f) AS upto
        FROM st, range(5) t(f) WHERE f < k - 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY gesture_label ORDER BY sha256('42:' || sample_id), sample_id) - 1 AS r FROM tr),
folds AS (SELECT sample_id, gesture_label,
            (SELECT count(*) FROM cut c WHERE c.gesture_label = rk.gesture_label AND c.upto <= rk.r) AS fold FROM rk)"""


@query("stratified_folds", f"{_FOLDS} SELECT sample_id, gesture_label, fold FROM folds")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = given.manifest(spark, sf_dir)
    folds = splits.stratified_folds(manifest, 5, 42, splits.stratified_split(manifest))
    return folds.select("sample_id", "gesture_label", big("fold"))


@query(
    "split_job",
    f"""{_FOLDS} SELECT 'split' AS kind, split AS name, gesture_label, count(*) AS n FROM split GROUP BY 2, 3
        UNION ALL SELECT 'fold', fold::VARCHAR, gesture_label, count(*) FROM folds GROUP BY 2, 3""",
)
def split_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split and fold tables written, read back and counted."""
    result = jobs.split_job(given.manifest(spark, sf_dir), scratch_path(spark, "splits"))
    folds = result["folds"].groupBy(F.col("fold").cast("string").alias("name"), "gesture_label").agg(
        F.count(F.lit(1)).alias("n")
    )
    spread = result["distribution"].select(F.lit("split").alias("kind"), F.col("split").alias("name"), "gesture_label", "n")
    return spread.unionByName(folds.withColumn("kind", F.lit("fold")))


@query(
    "split_rows",
    f"""WITH {MANIFEST}, {split('manifest')}
        SELECT m.sample_id, m.image_path FROM manifest m JOIN split s USING (sample_id) WHERE s.split IN ('val', 'test')""",
)
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = given.manifest(spark, sf_dir)
    held = splits.rows_of_split(manifest, splits.stratified_split(manifest), "val", "test")
    return held.select("sample_id", "image_path")


@query(
    "class_cap",
    f"""WITH {MANIFEST} SELECT sample_id, gesture_label FROM (
          SELECT *, row_number() OVER (PARTITION BY gesture_label ORDER BY image_path, sample_id) AS r FROM manifest) WHERE r <= 100""",
)
def class_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.cap_per_class(given.manifest(spark, sf_dir), 100).select("sample_id", "gesture_label")


@query(
    "seeded_shuffle",
    f"""WITH {MANIFEST} SELECT sample_id, sha256('42:' || sample_id) AS order_key FROM manifest ORDER BY 2, 1""",
)
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = splits.seeded_order(given.manifest(spark, sf_dir))
    return ordered.select("sample_id", hash_order(42, F.col("sample_id")).alias("order_key"))


@query(
    "name_aliases",
    """SELECT DISTINCT l_returnflag AS flag,
         CASE l_returnflag WHEN 'A' THEN 'accuracy' WHEN 'N' THEN 'f1_macro' ELSE 'R' END AS metric,
         CASE l_returnflag WHEN 'A' THEN 'geometric' WHEN 'N' THEN 'hybrid_keypoints_hog' ELSE 'R' END AS family,
         CASE l_returnflag WHEN 'A' THEN 'svm' WHEN 'N' THEN 'naive_bayes' ELSE 'R' END AS algorithm FROM lineitem""",
)
def name_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric, family and algorithm aliases looked up for all lines, then told apart."""
    flag = F.col("l_returnflag")
    pick = lambda a, n: F.when(flag == "A", a).when(flag == "N", n).otherwise(flag)
    return (
        given.table(spark, sf_dir, "lineitem")
        .select(
            flag.alias("flag"),
            names.metric_name_column(pick("acc", "f1")).alias("metric"),
            names.stored_family_column(pick("keypoints_only", "hybrid")).alias("family"),
            names.algorithm_name_column(pick("svm_rbf", "naive_bayes_gaussian")).alias("algorithm"),
        )
        .distinct()
    )


