"""The named queries of the engine over the test tables, and their SQL twins.

Orders stand for encounters, customers for patients, and line items for their facts: a
line's number gives the resource, its part's name the text, its quantity the value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import schemas as S
from quillspark.functions import fuzzy, parse, text
from quillspark.operators import bundles, external, faithful, passes, prompts, report, sampling, scoring, similar, splits, stats
from quillspark.sources import completer, files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_NAMES = "['conditions', 'medications', 'allergies', 'vitals', 'procedures']"
_FACTS = f"facts AS (SELECT l_orderkey AS row_id, l_linenumber AS pos, {_NAMES}[(l_linenumber - 1) % 5 + 1] AS resource, p_name AS text, l_quantity AS value FROM lineitem JOIN part ON l_partkey = p_partkey)"
_PRED = "drawn AS (SELECT *, substr(md5(concat(row_id, ':', pos)), 1, 1) AS d FROM facts), pred AS (SELECT row_id, pos, resource, CASE WHEN d = '0' THEN concat(text, ' extra') ELSE text END AS text, value FROM drawn WHERE d < 'd')"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    resource = F.element_at(F.array(*map(F.lit, S.RESOURCES)), ((F.col("l_linenumber") - 1) % 5 + 1).cast("int"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("pos"), resource.alias("resource"), F.col("p_name").alias("text"), F.col("l_quantity").alias("value"))


def predicted(gold: DataFrame) -> DataFrame:
    d = F.substring(F.md5(F.concat_ws(":", "row_id", "pos").cast("binary")), 1, 1)
    return gold.withColumn("d", d).where("d < 'd'").withColumn("text", F.when(F.col("d") == "0", F.concat("text", F.lit(" extra"))).otherwise(F.col("text"))).drop("d")


_COUNTS = f"""{_FACTS}, {_PRED},
sides AS (SELECT row_id, resource, text AS key, 1 AS p, 0 AS g FROM pred UNION ALL SELECT row_id, resource, text, 0, 1 FROM facts),
keyed AS (SELECT row_id, resource, key, sum(p) AS p, sum(g) AS g FROM sides GROUP BY ALL),
counts AS (SELECT row_id, resource, CAST(sum(least(p, g)) AS BIGINT) AS tp, CAST(sum(p - least(p, g)) AS BIGINT) AS fp, CAST(sum(g - least(p, g)) AS BIGINT) AS fn FROM keyed GROUP BY ALL)"""


def _counts(spark, sf_dir):
    gold = facts(spark, sf_dir)
    return scoring.exact_counts(predicted(gold).withColumnRenamed("text", "key"), gold.withColumnRenamed("text", "key"), "row_id")


@query(
    f"""WITH {_COUNTS},
sums AS (SELECT resource, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM counts GROUP BY ROLLUP (resource)),
each AS (SELECT coalesce(resource, 'micro') AS resource, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 2.0 * tp / (2.0 * tp + fp + fn) END::DOUBLE AS f1 FROM sums)
SELECT resource, tp, fp, fn, round(f1, 4) AS f1 FROM each
UNION ALL SELECT 'macro', 0, 0, 0, round(avg(f1), 4) FROM each WHERE resource <> 'micro' AND tp + fp + fn > 0"""
)
def f1_scoring(spark, sf_dir):
    return scoring.corpus_scores(_counts(spark, sf_dir))


@query(f"WITH {_COUNTS} SELECT row_id, resource, tp, fp, fn FROM counts")
def exact_multiset_match(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(
    f"""WITH {_COUNTS},
rows AS (SELECT row_id, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(fp) AS hallucinated, (sum(fp) = 0) AS valid FROM counts GROUP BY row_id),
each AS (SELECT resource, CASE WHEN sum(tp) = 0 THEN 0.0::DOUBLE ELSE CAST(2.0 * sum(tp) / (2.0 * sum(tp) + sum(fp) + sum(fn)) AS DOUBLE) END AS f1, sum(tp + fp + fn) AS n FROM counts GROUP BY resource)
SELECT count(*) AS n, round(CAST(2.0 * sum(tp) / (2.0 * sum(tp) + sum(fp) + sum(fn)) AS DOUBLE), 4) AS micro_f1, (SELECT round(avg(f1) FILTER (n > 0), 4) FROM each) AS macro_f1,
  (SELECT string_agg(resource || '=' || printf('%.4f', round(f1, 4)), ' ' ORDER BY resource) FROM each) AS per_resource, round(avg(CAST(valid AS INT)), 4) AS schema_validity, round(avg(hallucinated), 4) AS hallucination_rate, round(avg(fn), 4) AS omission_rate FROM rows"""
)
def corpus_aggregate(spark, sf_dir):
    rows = scoring.row_scores(_counts(spark, sf_dir), "row_id").withColumn("hallucinated", F.col("fp")).withColumn("schema_valid", F.col("fp") == 0)
    told = F.array_join(F.transform(F.array_sort(F.map_entries("per_resource")), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"]))), " ")
    return scoring.aggregate(rows).select("n", "micro_f1", "macro_f1", told.alias("per_resource"), "schema_validity", "hallucination_rate", "omission_rate")


@query(
    f"""WITH {_COUNTS} SELECT row_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM counts WHERE resource IN ('conditions', 'procedures') GROUP BY row_id"""
)
def restricted_scores(spark, sf_dir):
    return scoring.row_scores(_counts(spark, sf_dir), "row_id", scoring.check_resources("conditions, procedures")).select("row_id", "tp", "fp", "fn")


@query(
    f"""WITH {_FACTS}
SELECT o_orderkey AS encounter_id, o_custkey AS patient_id, strftime(o_orderdate, '%Y-%m-%d') AS encounter_date, count(*) AS n_facts,
  string_agg(resource || ':' || text, '|' ORDER BY pos, resource || ':' || text) AS facts, CAST(count(*) FILTER (resource = 'vitals') AS BIGINT) AS n_vitals
FROM orders JOIN facts ON row_id = o_orderkey GROUP BY ALL"""
)
def encounter_group(spark, sf_dir):
    grouped = facts(spark, sf_dir).groupBy("row_id").agg(F.count(F.lit(1)).alias("n_facts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(":", "resource", "text").alias("f")))), lambda s: s["f"]), "|").alias("facts"), F.count_if(F.col("resource") == "vitals").alias("n_vitals"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return orders.join(grouped, F.col("o_orderkey") == F.col("row_id")).select(F.col("o_orderkey").alias("encounter_id"), F.col("o_custkey").alias("patient_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("encounter_date"), "n_facts", "facts", "n_vitals")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, record: orders with their facts as records; a vital sign's code goes by its position."""
    codes = F.array(*map(F.lit, S.DISPLAYS))
    f = facts(spark, sf_dir)
    one = {
        "conditions": F.struct(F.col("text").alias("code_text"), F.lit("active").alias("clinical_status"), F.lit(None).cast("string").alias("onset_date")),
        "medications": F.struct(F.col("text").alias("medication_text"), F.struct(F.col("value").alias("dose"), F.lit("mg").alias("unit"), F.lit(None).cast("string").alias("route"), F.lit("daily").alias("frequency")).alias("dosage"), F.lit("active").alias("status")),
        "allergies": F.struct(F.col("text").alias("substance_text"), F.array(F.lit("rash")).alias("manifestation"), F.lit("low").alias("criticality")),
        "vitals": F.struct(F.element_at(codes, (F.col("pos") % 8 + 1).cast("int")).alias("loinc_code"), F.lit("").alias("display"), F.col("value").alias("value"), F.lit("u").alias("unit")),
        "procedures": F.struct(F.col("text").alias("code_text"), F.lit("2020-01-02").alias("performed_date"), F.lit("completed").alias("status")),
    }
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("resource") == r, F.struct("pos", one[r].alias("x"))))), lambda s: s["x"]).alias(r) for r in S.RESOURCES]
    grouped = f.groupBy("row_id").agg(*lists)
    return grouped.select("row_id", parse.with_defaults(F.struct(*S.RESOURCES).cast(S.RECORD)).alias("record"))


@query(
    f"""WITH {_FACTS}, rows AS (SELECT row_id, count(*) FILTER (resource = 'vitals') AS v, count(*) FILTER (resource = 'allergies') AS a FROM facts GROUP BY row_id)
SELECT count(*) FILTER (v > 0) AS vitals, count(*) FILTER (v = 0) AS no_vitals, count(*) FILTER (a > 0) AS allergies, count(*) AS non_empty FROM rows"""
)
def pass_filters(spark, sf_dir):
    return records(spark, sf_dir).agg(*[F.count_if(passes.matches(m)).alias(m) for m in passes.MODES], F.count_if(passes.non_empty()).alias("non_empty"))


@query(
    """WITH done AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey AS encounter_id, o_custkey AS patient_id FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM done)
ORDER BY o_custkey, o_orderkey LIMIT (SELECT greatest(1, count(*) // 4) FROM done)"""
)
def resume_anti_join(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("encounter_id"), F.col("o_custkey").alias("patient_id"), "o_orderstatus")
    done = rows.where("o_orderstatus = 'F'")
    n = done.count()
    return passes.work_list(rows, done, n + n // 4, "patient_id", "encounter_id").select("encounter_id", "patient_id")


def _placed(where: str = "", seed: int = 42) -> str:
    return f"""counts AS (SELECT o_custkey, count(*) AS n{where} FROM orders GROUP BY o_custkey),
placed AS (SELECT *, coalesce(sum(n) OVER (ORDER BY md5(concat('{seed}:', o_custkey)), o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM counts)"""


@query(
    f"""WITH {_placed()}, ends AS (SELECT (SELECT min(cum) FROM placed WHERE cum >= 50) AS a),
e2 AS (SELECT a, (SELECT min(cum) FROM placed WHERE cum >= a + 70) AS b FROM ends)
SELECT o_orderkey, orders.o_custkey, CASE WHEN cum < a THEN 'val' WHEN cum < b THEN 'test_synthetic' ELSE 'train' END AS split FROM orders JOIN placed USING (o_custkey), e2"""
)
def quota_split(spark, sf_dir):
    return splits.split_by_entity(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", {"train": 100, "val": 50, "test_synthetic": 70}, 42)


@query(
    f"""WITH {_placed()}, ends AS (SELECT (SELECT min(cum) FROM placed WHERE cum >= 50) AS a),
e2 AS (SELECT a, (SELECT min(cum) FROM placed WHERE cum >= a + 70) AS b FROM ends),
s AS (SELECT o_orderkey, CASE WHEN cum < a THEN 'val' WHEN cum < b THEN 'test_synthetic' ELSE 'train' END AS split FROM orders JOIN placed USING (o_custkey), e2)
SELECT split, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM s GROUP BY split"""
)
def split_files(spark, sf_dir):
    """Splits written as JSON lines by split, and read back."""
    at = files.scratch(spark)
    report.write_splits(quota_split(spark, sf_dir), at)
    return files.json_lines(spark, at, "o_orderkey long, o_custkey long, split string").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS encounter_id FROM orders WHERE o_custkey % 3 < 2")
def checkpoint_files(spark, sf_dir):
    """Pairs appended in two goes, the second of which repeats some of the first, beside a line that isn't JSON: the ids that are done."""
    at = files.scratch(spark)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("encounter_id"), F.col("o_custkey").alias("customer"), F.lit("n").alias("note"))
    report.append_pairs(rows.where("customer % 3 = 0"), at)
    spark.range(1).select(F.lit('{"encounter_id": "cut sho').alias("value")).write.mode("append").text(at)
    report.append_pairs(rows.where("customer % 3 < 2 and (customer % 3 = 1 or customer % 2 = 0)"), at)
    return files.done_ids(spark, at)


@query("SELECT n_nationkey AS pos, n_name FROM nation WHERE n_nationkey < 7")
def array_file(spark, sf_dir):
    """A table as one JSON array in a file, of which the first seven elements are read."""
    at = files.scratch(spark)
    one = table(spark, sf_dir, "nation").agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value"))
    one.coalesce(1).write.text(at)
    return files.json_array(spark, at, S.T._parse_datatype_string("n_nationkey int, n_name string"), 7).select("pos", "n_name")


@query("SELECT 'n_name' AS key, count(*) AS n FROM nation UNION ALL SELECT 'even', count(*) FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'third', count(*) FROM nation WHERE n_nationkey % 3 = 0")
def json_tree_keys(spark, sf_dir):
    """Keys of JSON objects in files below a folder, whose fields differ."""
    at = files.scratch(spark)
    rows = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, True).alias("even"), F.when(F.col("n_nationkey") % 3 == 0, 1).alias("third"))
    rows.write.partitionBy("n_regionkey", "n_nationkey").json(at)
    return stats.key_counts(files.json_objects(spark, at), "body")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS patient_id, CAST(c_custkey AS VARCHAR) AS encounter_id, c_mktsegment AS condition FROM customer JOIN nation ON n_nationkey = c_nationkey")
def bundle_files(spark, sf_dir):
    """A bundle file for each nation, whose customers are encounters with one condition each, read back and un-nested."""
    at = files.scratch(spark)
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("folder"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("folder"), F.lit(1).alias("part"), "c_custkey", "c_mktsegment").join(F.broadcast(nations), "folder", "left_semi")
    ends = nations.withColumn("part", F.explode(F.array(F.lit(0), F.lit(2))))
    # a bundle's rows lie in one task, sorted there, and become text as they are written: no row holds a bundle
    rows = customers.unionByName(ends, allowMissingColumns=True).repartition("folder").sortWithinPartitions("folder", "part", "c_custkey")
    key = F.col("c_custkey").cast("string")
    entry = lambda kind, *fields: F.to_json(F.struct(F.struct(F.lit(kind).alias("resourceType"), *fields).alias("resource")))
    visit = entry("Encounter", key.alias("id"))
    said = entry("Condition", F.struct(F.concat(F.lit("Encounter/"), key).alias("reference")).alias("encounter"), F.struct(F.col("c_mktsegment").alias("text")).alias("code"))
    patient = entry("Patient", F.col("folder").cast("string").alias("id"))
    line = F.when(F.col("part") == 0, F.concat(F.lit('{"entry":['), patient)).when(F.col("part") == 1, F.concat(F.lit(","), visit, F.lit(","), said)).otherwise("]}")
    files.write_lines(rows.select("folder", line.alias("value")), at, "folder")
    read = bundles.encounters(files.bundles(spark, at))
    return read.select("patient_id", "encounter_id", F.array_join(F.transform("record.conditions", lambda c: c["code_text"]), "|").alias("condition"))


@query(
    """WITH counts AS (SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS n FROM orders GROUP BY o_custkey HAVING n > 0),
held AS (SELECT o_custkey FROM (SELECT o_custkey, coalesce(sum(n) OVER (ORDER BY md5(concat('42:', o_custkey)), o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM counts) WHERE cum < 60)
SELECT o_orderkey, o_custkey, o_custkey IN (SELECT o_custkey FROM held) AS held FROM orders"""
)
def slice_holdout(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return splits.reserve_slice(rows, "o_custkey", F.col("o_orderpriority") == "1-URGENT", 60, 42).select("o_orderkey", "o_custkey", "held")


@query(
    f"""WITH {_placed(seed=7)}, ends AS (SELECT min(cum) AS a FROM placed WHERE cum >= 100)
SELECT split, count(*) AS n, count(DISTINCT o_custkey) AS patients FROM (SELECT o_custkey, CASE WHEN cum < a THEN 'val' ELSE 'train' END AS split FROM orders JOIN placed USING (o_custkey), ends) GROUP BY split"""
)
def two_way_split(spark, sf_dir):
    return splits.two_way(table(spark, sf_dir, "orders").select("o_custkey"), "o_custkey", 100, 7).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("patients"))


@query(
    f"""WITH {_FACTS}, able AS (SELECT *, count(*) OVER (PARTITION BY row_id, resource) AS n,
  CAST(('0x' || substr(md5(concat('42:', row_id, ':', resource, ':rate')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u, md5(concat('42:', row_id, ':', resource, ':', pos, ':draw')) AS draw FROM facts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id, resource ORDER BY draw, text) AS r,
  CASE WHEN n <= 3 THEN n ELSE greatest(1, CAST(round_even(n * (CASE resource WHEN 'conditions' THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END + CASE resource WHEN 'conditions' THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END * u), 0) AS BIGINT)) END AS q FROM able),
told AS (SELECT *, CASE WHEN resource = 'vitals' THEN true WHEN resource = 'allergies' THEN CAST(('0x' || substr(draw, 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < 0.7 ELSE r <= q END AS t FROM ranked),
kept AS (SELECT *, bool_or(t) OVER (PARTITION BY row_id) AS any_told, min(pos) OVER (PARTITION BY row_id) AS first_pos FROM told)
SELECT row_id, resource, pos, text FROM kept WHERE t OR (resource = 'allergies' AND NOT any_told AND pos = first_pos)"""
)
def hash_sample(spark, sf_dir):
    return sampling.sampled(facts(spark, sf_dir), "row_id", "resource", "pos", "text", 42).select("row_id", "resource", "pos", "text")


@query("SELECT o_orderkey, substr(sha256(concat('42:', o_orderkey)), 1, 16) AS seed_hex, ['a', 'b', 'c', 'd'][1 + CAST(floor(CAST(('0x' || substr(md5(concat('42:', o_orderkey, ':style')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE * 4) AS INT)] AS style FROM orders")
def seeded_choices(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lower(F.lpad(F.conv(sampling.exact_seed(42, key).cast("string"), 10, 16), 16, "0")).alias("seed_hex"), sampling.pick(42, key, "style", ("a", "b", "c", "d")).alias("style"))


_TAGS = (" (disorder)", " (finding)", " (procedure) ", " (Situation)", " (regime/therapy)", " LEFT knee, stage 3!", " (not a tag)", "")
_TERMS = "terms AS (SELECT p_partkey, concat(p_name, [" + ", ".join(f"'{t}'" for t in _TAGS) + "][p_partkey % 8 + 1]) AS term FROM part)"
_SQL_NORMALISE = r"regexp_replace(lower(CASE WHEN lower(trim(regexp_extract(trim(term), '^(.*)\s*\(([a-zA-Z/ ]+)\)\s*$', 2))) IN ('disorder', 'finding', 'procedure', 'situation', 'regime/therapy', 'substance', 'morphologic abnormality') THEN trim(regexp_extract(trim(term), '^(.*)\s*\(([a-zA-Z/ ]+)\)\s*$', 1)) ELSE term END), '[^a-z0-9 ]+', ' ', 'g')"


def _terms(spark, sf_dir):
    tags = F.array(*map(F.lit, _TAGS))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.element_at(tags, (F.col("p_partkey") % 8 + 1).cast("int"))).alias("term"))


@query(f"WITH {_TERMS} SELECT p_partkey, {_SQL_NORMALISE} AS normalised FROM terms")
def normalise(spark, sf_dir):
    return _terms(spark, sf_dir).select("p_partkey", text.normalise(F.col("term")).alias("normalised"))


_ADDED = ("", " screening", " Education", " stress (finding)", " housing (disorder)", " interview (situation)")
_MORE = "more AS (SELECT p_partkey, concat(term, [" + ", ".join(f"'{t}'" for t in _ADDED) + "][p_partkey % 6 + 1]) AS t, ['conditions', 'procedures', 'medications'][p_partkey % 3 + 1] AS resource FROM terms)"


@query(
    f"WITH {_TERMS}, {_MORE} SELECT p_partkey, resource, NOT (trim(lower(t)) IN ('', 'unknown') OR regexp_extract(lower(t), '\\(([a-z]+)\\)\\s*$', 1) = 'situation' OR (resource = 'procedures' AND regexp_matches(lower(t), '{'|'.join(S.ADMIN_WORDS)}')) OR (resource = 'conditions' AND regexp_extract(lower(t), '\\(([a-z]+)\\)\\s*$', 1) = 'finding' AND regexp_matches(lower(t), '{'|'.join(S.SOCIAL_WORDS)}'))) AS narratable FROM more"
)
def narratable(spark, sf_dir):
    added, names = F.array(*map(F.lit, _ADDED)), F.array(*map(F.lit, ("conditions", "procedures", "medications")))
    at = lambda a, n: F.element_at(a, (F.col("p_partkey") % n + 1).cast("int"))
    rows = _terms(spark, sf_dir).select("p_partkey", at(names, 3).alias("resource"), F.concat("term", at(added, 6)).alias("t"))
    return rows.select("p_partkey", "resource", text.is_narratable(F.col("t"), F.col("resource")).alias("narratable"))


_A, _B = ("type 1 x", "left knee", "hyperglycemia", "acute pain", "stage 3 and 4", "plain"), ("type 2 x", "right knee", "hypoglycemia", "chronic pain", "stage 4 and 3", "plain")


@query(
    "WITH pairs AS (SELECT p_partkey, [" + ", ".join(f"'{a}'" for a in _A) + "][p_partkey % 6 + 1] || ' ' || p_brand AS a, [" + ", ".join(f"'{b}'" for b in _B) + "][(p_partkey + p_size) % 6 + 1] || ' ' || p_brand AS b FROM part), "
    r"""words AS (SELECT *, string_split(a, ' ') AS x, string_split(b, ' ') AS y, list_sort(list_distinct(regexp_extract_all(a, '\d+'))) AS m, list_sort(list_distinct(regexp_extract_all(b, '\d+'))) AS n FROM pairs)
SELECT p_partkey, m <> n OR (list_contains(x, 'left') AND list_contains(y, 'right')) OR (list_contains(x, 'right') AND list_contains(y, 'left')) OR """
    + " OR ".join(f"(len(list_filter(x, lambda w: starts_with(w, '{p}'))) > 0 AND len(list_filter(y, lambda w: starts_with(w, '{q}'))) > 0)" for p, q in [*S.OPPOSED, *[(q, p) for p, q in S.OPPOSED]])
    + " AS conflict FROM words"
)
def conflict(spark, sf_dir):
    a, b = F.array(*map(F.lit, _A)), F.array(*map(F.lit, _B))
    first = F.concat_ws(" ", F.element_at(a, (F.col("p_partkey") % 6 + 1).cast("int")), "p_brand")
    second = F.concat_ws(" ", F.element_at(b, ((F.col("p_partkey") + F.col("p_size")) % 6 + 1).cast("int")), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", text.discriminators_conflict(first, second).alias("conflict"))


_NOTE = "concat('BP: ', 90 + l_orderkey % 60, '/', 50 + l_linenumber, ' hr ', 50 + l_linenumber, ', RR ', 10 + l_linenumber % 9, '. Temp: 9', l_linenumber % 9, '.5 SpO2 ', 90 + l_linenumber, ' weight ', CAST(l_quantity AS INT) + 20, ' Ht ', 150 + l_linenumber)"


def _notes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.expr(_NOTE).alias("note"))


def _sql_vitals() -> str:
    parts, k = [], 0
    for pattern, keys, unit in S.VITAL_PATTERNS:
        for i, key in enumerate(keys):
            k += 1
            parts.append(f"SELECT l_orderkey, l_linenumber, {k} AS k, '{S.VITALS[key][0]}' AS loinc_code, '{unit}' AS unit, unnest(regexp_extract_all(note, '(?i){pattern}', {i + 1})) AS v FROM notes")
    return " UNION ALL ".join(parts)


@query(f"WITH notes AS (SELECT l_orderkey, l_linenumber, {_NOTE} AS note FROM lineitem), found AS ({_sql_vitals()}) SELECT loinc_code, unit, CAST(v AS DOUBLE) AS value, count(*) AS n FROM found GROUP BY ALL")
def regex_vitals(spark, sf_dir):
    found = _notes(spark, sf_dir).select(F.inline(text.vitals_in(F.col("note"))))
    return found.groupBy("loinc_code", "unit", "value").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH notes AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q, {_NOTE} AS note FROM lineitem) SELECT l_orderkey, l_linenumber, regexp_matches(note, concat('\\b', q, '\\b')) OR regexp_matches(note, concat('\\b', q, '\\.0\\b')) AS anchored FROM notes")
def number_anchors(spark, sf_dir):
    return _notes(spark, sf_dir).select("l_orderkey", "l_linenumber", text.number_anchored(F.col("l_quantity"), F.col("note")).alias("anchored"))


_MEASURE = "CASE l_linenumber % 3 WHEN 0 THEN l_quantity + l_discount WHEN 1 THEN -(l_extendedprice / 100) ELSE l_quantity / 2 + l_tax END"


@query(f"""WITH m AS (SELECT l_orderkey, l_linenumber, CAST({_MEASURE} AS DOUBLE) AS v FROM lineitem), t AS (SELECT *, printf('%.0f', v) AS whole, printf('%.1f', v) AS tenth FROM m)
SELECT l_orderkey, l_linenumber, v, whole, tenth, true AS anchored FROM t""")
def number_rounding(spark, sf_dir):
    """Numbers with and without fractions as text, and whether a note that tells the one with a tenth anchors them."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_MEASURE).cast("double").alias("v"))
    tenth = text.printf_tenth(F.col("v"))
    return rows.select("*", text.printf_whole(F.col("v")).alias("whole"), tenth.alias("tenth"), text.number_anchored(F.abs("v"), F.concat(F.lit("was "), text.printf_tenth(F.abs("v")), F.lit(" today"))).alias("anchored"))


_LIST = "CASE p_partkey % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN concat(' ', p_name, ' ;; ', p_brand, ';') WHEN 2 THEN concat(p_type, '; n/a') WHEN 3 THEN ' None ' ELSE p_name END"


@query(f"WITH v AS (SELECT p_partkey, {_LIST} AS v FROM part), s AS (SELECT p_partkey, CASE WHEN lower(trim(v)) IN ('', 'n/a', 'na', 'none', 'not applicable') THEN [] ELSE list_filter(list_transform(string_split(v, ';'), lambda x: trim(x)), lambda x: x <> '') END AS l FROM v) SELECT p_partkey, CAST(len(l) AS INT) AS n, array_to_string(l, '|') AS entries FROM s")
def semicolon_split(spark, sf_dir):
    entries = text.split_entries(F.expr(_LIST))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(entries).alias("n"), F.array_join(entries, "|").alias("entries"))


def _sql_distinct(n: int) -> str:
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"SELECT {n} AS n, CAST(count(DISTINCT g) AS DOUBLE) / count(*) AS distinct_ratio FROM (SELECT unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: {gram})) AS g FROM words WHERE len(w) >= {n})"


@query(f"WITH words AS (SELECT list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS w FROM documents) {_sql_distinct(2)} UNION ALL {_sql_distinct(3)}")
def distinct_ngrams(spark, sf_dir):
    return stats.distinct_n(table(spark, sf_dir, "documents").select("text"), "text", 2, 3)


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def percentiles(spark, sf_dir):
    return stats.nearest_rank(table(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value", 0.5, 0.95)


@query("""WITH r AS (SELECT event_type, count(*) AS notes, sum(user_id % 10 + 1) AS s, sum(user_id) AS i, sum(event_id % 50) AS o FROM events GROUP BY event_type),
q AS (SELECT *, round(notes / CAST(s AS DOUBLE), 3) AS notes_per_s FROM r)
SELECT event_type, notes, notes_per_s, round(i / CAST(notes AS DOUBLE), 1) AS prompt_tokens_per_note, round(o / CAST(s AS DOUBLE), 1) AS output_tokens_per_s, round(1e6 / notes_per_s / 3600 * 0.8, 2) AS usd_per_million FROM q""")
def serving_throughput(spark, sf_dir):
    runs = table(spark, sf_dir, "events").selectExpr("event_type", "cast(user_id % 10 + 1 as double) as s", "user_id as i", "event_id % 50 as o")
    return stats.throughput(runs, "event_type", "s", "i", "o", 0.8)


@query("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(CAST(props AS JSON))) AS key FROM events) GROUP BY key")
def key_counts(spark, sf_dir):
    return stats.key_counts(table(spark, sf_dir, "events").select("props"), "props")


_NAMED = "p_type || CASE p_partkey % 4 WHEN 0 THEN ' diagnosis' WHEN 1 THEN ' Drug therapy' WHEN 2 THEN ' vital' ELSE '' END"


@query("WITH k AS (SELECT DISTINCT lower(" + _NAMED + ") AS key FROM part) " + " UNION ALL ".join(f"SELECT '{r}' AS resource, count(*) FILTER (regexp_matches(key, '{'|'.join(w)}')) AS n_hits FROM k" for r, w in S.CATEGORY_WORDS.items()))
def category_coverage(spark, sf_dir):
    return stats.coverage(table(spark, sf_dir, "part").select(F.expr(_NAMED).alias("key")).distinct())


@query("WITH k AS (SELECT DISTINCT lower(" + _NAMED + ") AS key FROM part), h AS (" + " UNION ALL ".join(f"SELECT count(*) FILTER (regexp_matches(key, '{'|'.join(w)}')) AS n_hits FROM k" for w in S.CATEGORY_WORDS.values()) + ") SELECT count(*) FILTER (n_hits > 0) AS n_covered, count(*) FILTER (n_hits > 0) >= 3 AS enough FROM h")
def coverage_decision(spark, sf_dir):
    return stats.coverage_decision(stats.coverage(table(spark, sf_dir, "part").select(F.expr(_NAMED).alias("key")).distinct()))


@query(f"""WITH {_FACTS}, {_PRED},
rows AS (SELECT row_id, count(*) AS n FROM facts GROUP BY row_id), lost AS (SELECT row_id, count(*) AS n FROM drawn WHERE d >= 'd' GROUP BY row_id), made AS (SELECT row_id, count(*) AS n FROM drawn WHERE d = '0' GROUP BY row_id),
c AS (SELECT row_id, coalesce(l.n, 0) AS m, coalesce(a.n, 0) AS i FROM rows r LEFT JOIN lost l USING (row_id) LEFT JOIN made a USING (row_id))
SELECT r.*, raw_pairs, kept_pairs, drop_rate, drop_rate_missing, drop_rate_invented FROM (SELECT count(*) AS raw_pairs, count(*) FILTER (m = 0 AND i = 0) AS kept_pairs, round(count(*) FILTER (m > 0 OR i > 0) / count(*)::DOUBLE, 4) AS drop_rate, round(count(*) FILTER (m > 0) / count(*)::DOUBLE, 4) AS drop_rate_missing, round(count(*) FILTER (i > 0) / count(*)::DOUBLE, 4) AS drop_rate_invented FROM c), (SELECT {", ".join(f"count(DISTINCT row_id) FILTER (resource = '{r}') AS {r}" for r in S.RESOURCES)} FROM facts) r""")
def rates_manifest(spark, sf_dir):
    d = F.substring(F.md5(F.concat_ws(":", "row_id", "pos").cast("binary")), 1, 1)
    rows = facts(spark, sf_dir).withColumn("d", d).groupBy("row_id").agg(F.collect_list(F.when(F.col("d") >= "d", F.col("text"))).alias("missing"), F.collect_list(F.when(F.col("d") == "0", F.col("text"))).alias("invented"))
    return report.manifest(stats.drop_rates(rows), rows=stats.rows_by_resource(records(spark, sf_dir), "record")).select("*", "rows.*").drop("rows")


@query(f"WITH {_FACTS}, r AS (SELECT row_id, list(DISTINCT resource) AS l FROM facts GROUP BY row_id) SELECT " + ", ".join(f"count(*) FILTER (list_contains(l, '{r}')) AS {r}" for r in S.RESOURCES) + " FROM r")
def resource_rows(spark, sf_dir):
    return stats.rows_by_resource(records(spark, sf_dir), "record")


@query(
    """WITH RECURSIVE names AS (SELECT DISTINCT array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS s, p_name FROM part), pairs AS (SELECT a.p_name AS a, b.p_name AS b, a.s AS x, b.s AS y FROM names a JOIN names b ON a.p_name < b.p_name),
lcs AS (SELECT a, b, x, y, 0 AS i, list_transform(range(0, len(y) + 1), lambda k: 0) AS row FROM pairs
  UNION ALL SELECT a, b, x, y, i + 1, list_reduce(list_transform(range(1, len(y) + 1), lambda j: [CASE WHEN x[i + 1] = y[j] THEN row[j] + 1 ELSE row[j + 1] END]), lambda acc, e: list_append(acc, greatest(acc[len(acc)], e[1])), [0]) FROM lcs WHERE i < len(x))
SELECT a, b, round(200.0 * row[len(row)] / (len(x) + len(y)), 6)::DOUBLE AS similarity FROM lcs WHERE i = len(x) AND 200.0 * row[len(row)] >= 70 * (len(x) + len(y))"""
)
def token_sort_similarity(spark, sf_dir):
    return similar.similar_terms(table(spark, sf_dir, "part"), "p_name", 70).withColumn("similarity", F.round("similarity", 6))


@query(
    f"""WITH RECURSIVE {_FACTS},
golds AS (SELECT row_id, resource, text AS key, row_number() OVER (PARTITION BY row_id, resource ORDER BY pos, text) AS j FROM facts),
said AS (SELECT row_id, resource, pos, CASE WHEN pos % 2 = 0 THEN 'the ' || text ELSE reverse(text) END AS key FROM facts),
preds AS (SELECT row_id, resource, key, row_number() OVER (PARTITION BY row_id, resource ORDER BY pos, key) AS i FROM said),
pairs AS (SELECT DISTINCT p.key AS a, g.key AS b, array_to_string(list_sort(string_split(p.key, ' ')), ' ') AS x, array_to_string(list_sort(string_split(g.key, ' ')), ' ') AS y FROM preds p JOIN golds g USING (row_id, resource) WHERE resource <> 'vitals'),
lcs AS (SELECT a, b, x, y, 0 AS i, list_transform(range(0, len(y) + 1), lambda k: 0) AS row FROM pairs
  UNION ALL SELECT a, b, x, y, i + 1, list_reduce(list_transform(range(1, len(y) + 1), lambda j: [CASE WHEN x[i + 1] = y[j] THEN row[j] + 1 ELSE row[j + 1] END]), lambda acc, e: list_append(acc, greatest(acc[len(acc)], e[1])), [0]) FROM lcs WHERE i < len(x)),
sim AS (SELECT a, b, 200.0 * row[len(row)] / (len(x) + len(y)) AS s FROM lcs WHERE i = len(x)),
grid AS (SELECT p.row_id, p.resource, p.i, list(CASE WHEN p.key = g.key THEN 100.0 WHEN s >= 88 THEN s ELSE -1.0 END ORDER BY g.j) AS m FROM preds p JOIN golds g ON p.row_id = g.row_id AND p.resource = g.resource LEFT JOIN sim ON p.resource <> 'vitals' AND a = p.key AND b = g.key GROUP BY ALL),
walk AS (SELECT row_id, resource, CAST(0 AS BIGINT) AS i, list_transform(list(j), lambda k: false) AS used, CAST(0 AS BIGINT) AS tp, count(*) AS n FROM golds GROUP BY ALL
  UNION ALL SELECT w.row_id, w.resource, w.i + 1, list_transform(used, lambda u, k: u OR (best >= 88 AND k = list_position(left_, best))), tp + CAST(best >= 88 AS INT), n
  FROM (SELECT w.*, list_transform(m, lambda v, k: CASE WHEN used[k] THEN -1.0 ELSE v END) AS left_, list_max(list_transform(m, lambda v, k: CASE WHEN used[k] THEN -1.0 ELSE v END)) AS best FROM walk w JOIN grid g ON w.row_id = g.row_id AND w.resource = g.resource AND g.i = w.i + 1) w)
SELECT row_id, resource, tp, n - tp AS fp, n - tp AS fn FROM walk WHERE i = n"""
)
def fuzzy_match(spark, sf_dir):
    gold = facts(spark, sf_dir).withColumnRenamed("text", "key")
    pred = gold.withColumn("key", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("the "), "key")).otherwise(F.reverse("key")))
    return scoring.fuzzy_counts(pred, gold, "row_id")


def _noted(spark, sf_dir):
    """Notes that tell the facts of each order by odd positions, and a drug that isn't a fact."""
    f = facts(spark, sf_dir)
    told = F.when(F.col("resource") == "vitals", F.concat(F.lit("BP "), F.col("value").cast("int") + 60, F.lit("/70"))).otherwise(F.col("text"))
    notes = f.groupBy("row_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("pos") % 2 == 1, F.struct("pos", told.alias("t"))))), lambda s: s["t"]), ", ").alias("told"))
    return f, notes.select("row_id", F.concat(F.lit("Seen today: "), "told", F.when(F.col("row_id") % 3 == 0, F.lit(". Takes aspirin.")).otherwise(".")).alias("note"))


@query()
def anchors(spark, sf_dir):
    f, notes = _noted(spark, sf_dir)
    return faithful.anchors(f, notes, "row_id").select("row_id", "resource", "pos", "anchored")


@query()
def faithfulness(spark, sf_dir):
    f, notes = _noted(spark, sf_dir)
    return faithful.checked(notes, f, "row_id").select("row_id", F.size("missing").alias("n_missing"), F.size("invented").alias("n_invented"), "faithful", "clean")


@query(f"""WITH {_FACTS}, told AS (SELECT row_id, string_agg(CASE WHEN resource = 'vitals' THEN 'bp ' || (CAST(value AS INT) + 60) || ' 70' ELSE text END, '  ' ORDER BY pos, CASE WHEN resource = 'vitals' THEN 'BP ' || (CAST(value AS INT) + 60) ELSE text END) FILTER (pos % 2 = 1) AS note FROM facts GROUP BY row_id)
SELECT row_id, pos, coalesce(contains(lower(note), lower(text)), false) AS plainly FROM facts LEFT JOIN told USING (row_id) WHERE resource <> 'vitals'""")
def plain_anchors(spark, sf_dir):
    f, notes = _noted(spark, sf_dir)
    wide = f.where("resource <> 'vitals'").join(notes, "row_id")
    return wide.select("row_id", "pos", text.anchored_plainly(text.strip(text.normalise(F.col("text"))), text.normalise(F.col("note"))).alias("plainly"))


_REPLY = """CASE p_partkey % 7
WHEN 0 THEN concat('{"conditions":[{"code_text":"', p_name, '","clinical_status":"active"}]}')
WHEN 1 THEN concat('```json', chr(10), '{"medications":[{"medication_text":"', p_name, '"}]}', chr(10), '```')
WHEN 2 THEN concat('<think>hm</think>', chr(10), '{"vitals":[{"loinc_code":"8867-4","value":', p_size, ',"unit":"/min"}]}')
WHEN 3 THEN concat('{"conditions":[{"code_text":"', p_name, '"}]}')
WHEN 4 THEN concat('{"conditions":[{"code_text":', p_size, ',"clinical_status":"active"}]}')
WHEN 5 THEN '{"allergies":null}'
ELSE concat('not json ', p_name) END"""


@query(f"SELECT p_partkey, p_partkey % 7 < 3 AS parsed, CAST(p_partkey % 7 = 0 AS INT) AS n_conditions, CAST(p_partkey % 7 = 1 AS INT) AS n_medications, CASE WHEN p_partkey % 7 = 2 THEN CAST(p_size AS DOUBLE) END AS value, CASE WHEN p_partkey % 7 = 2 THEN 'Heart rate' END AS display FROM (SELECT *, {_REPLY} AS reply FROM part)")
def parse_replies(spark, sf_dir):
    rows = parse.parsed_records(table(spark, sf_dir, "part").select("p_partkey", F.expr(_REPLY.replace("chr(10)", "char(10)")).alias("reply")), "reply")
    first = F.get("record.vitals", F.lit(0))
    return rows.select("p_partkey", "parsed", F.size("record.conditions").alias("n_conditions"), F.size("record.medications").alias("n_medications"), first["value"].alias("value"), first["display"].alias("display"))


@query("SELECT conv_id, count(*) AS n, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS chat FROM conversations GROUP BY conv_id")
def chat_messages(spark, sf_dir):
    chats = prompts.conversations(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return chats.select("conv_id", F.size("messages").cast("long").alias("n"), F.array_join(F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n").alias("chat"))


_LINES = f"""codes AS (SELECT *, {list(S.DISPLAYS.values())!r}[pos % 8 + 1] AS display FROM facts),
lines AS (SELECT row_id, pos, value, CASE WHEN resource <> 'vitals' THEN text END AS tie, list_position({_NAMES}, resource) AS rank, CASE resource WHEN 'conditions' THEN '- Condition: ' || text || ', status active' WHEN 'medications' THEN '- Medication: ' || text || ' (' || CAST(value AS VARCHAR) || 'mg, daily)' WHEN 'allergies' THEN '- Allergy: ' || text || ', reaction: rash' WHEN 'vitals' THEN '- Vital sign: ' || display || ' = ' || CAST(value AS VARCHAR) || ' u' ELSE '- Procedure: ' || text || ' on 2020-01-02' END AS line FROM codes),
told AS (SELECT row_id, string_agg(line, chr(10) ORDER BY rank, pos, tie, value) AS facts FROM lines GROUP BY row_id)"""


_TUNED = "notes-lora"
_MODEL = f"CASE WHEN p_partkey % 2 = 0 THEN '{_TUNED}' ELSE 'other' END"
_NOTE_OF = "concat('Note of ', p_name, ' {schema} ', p_type, '. ', chr(10))"


def _sql_extraction() -> str:
    # the note goes in last: what looks like a field in it stays as it is
    head, tail = prompts.EXTRACT_PROMPT.replace("'", "''").split("{note}")
    schema = f"CASE WHEN model <> '{_TUNED}' THEN 'The JSON must validate against this schema:' || chr(10) || '{S.RECORD_DDL}' || chr(10) ELSE '' END"
    return f"replace('{head}', '{{schema}}', {schema}) || note || '{tail}'"


@query(f"WITH n AS (SELECT p_partkey, {_MODEL} AS model, {_NOTE_OF} AS note FROM part), p AS (SELECT *, {_sql_extraction()} AS prompt FROM n) SELECT p_partkey, sha256(prompt) AS prompt_sha256, 'user: ' || regexp_replace(note, '\\s+$', '') || '|assistant: ' || prompt[1:8] AS chat FROM p")
def extraction_prompts(spark, sf_dir):
    """Prompts with the schema but for the tuned model, and chat examples of the bare notes."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_MODEL).alias("model"), F.expr(_NOTE_OF.replace("chr(10)", "char(10)")).alias("note"))
    prompt = prompts.prompt_for(F.col("model"), _TUNED, F.col("note"))
    told = F.transform(prompts.chat(F.col("note"), F.substring(prompt, 1, 8)), lambda m: F.concat_ws(": ", m["role"], m["content"]))
    return rows.select("p_partkey", F.sha2(prompt.cast("binary"), 256).alias("prompt_sha256"), F.array_join(told, "|").alias("chat"))


@query(f"WITH {_FACTS}, {_LINES} SELECT row_id, facts FROM told")
def prompt_facts(spark, sf_dir):
    return records(spark, sf_dir).select("row_id", prompts.fact_lines(F.col("record")).alias("facts"))


def _sql_pick(purpose: str, choices: tuple[str, ...]) -> str:
    return f"{list(choices)!r}[1 + CAST(floor(CAST(('0x' || substr(md5(concat('42:', o_orderkey, ':{purpose}')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE * {len(choices)}) AS INT)]"


def _sql_fill(template: str, **values: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for k, v in values.items():
        out = f"replace({out}, '{{{k}}}', {v})"
    return out


@query(f"""WITH {_FACTS}, {_LINES},
drawn AS (SELECT o_orderkey, o_orderdate, facts, {_sql_pick("doc_type", S.DOC_TYPES)} AS doc_type, {_sql_pick("style", S.STYLES)} AS style, {_sql_pick("noise", S.NOISE)} AS noise FROM orders JOIN told ON row_id = o_orderkey),
filled AS (SELECT *, {_sql_fill(prompts.NOTE_PROMPT, date="strftime(o_orderdate, '%Y-%m-%d')", age="'50'", sex="'female'", doc_type="doc_type", style="style", noise="noise", facts="facts")} AS prompt FROM drawn)
SELECT o_orderkey AS encounter_id, doc_type, CAST(len(prompt) AS INT) AS prompt_chars, 'Note ' || substr(sha256(prompt), 1, 8) || '. ' || array_to_string(list_transform(string_split(facts, chr(10)), lambda l: regexp_replace(l, '^- [^:]*: ', '')), '. ') || '.' AS note FROM filled""")
def generated_notes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("encounter_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("encounter_date"), F.lit(50).alias("age"), F.lit("female").alias("sex"))
    rows = prompts.note_prompts(orders.join(records(spark, sf_dir), F.col("encounter_id") == F.col("row_id")), 42)
    notes = completer.complete(rows.select("encounter_id", "variant", "prompt"), completer.build("echo"))
    return notes.select("encounter_id", "variant.doc_type", F.length("prompt").alias("prompt_chars"), F.col("completion").alias("note"))


@query(f"""WITH {_FACTS} SELECT row_id, list_position({_NAMES}, resource) AS rank, pos, ['Condition', 'MedicationStatement', 'AllergyIntolerance', 'Observation', 'Procedure'][list_position({_NAMES}, resource)] AS kind, CASE WHEN resource = 'vitals' THEN NULL ELSE text END AS text FROM facts""".replace(f"list_position({_NAMES}, resource) AS rank, pos, ", ""))
def fhir_expand(spark, sf_dir):
    rows = records(spark, sf_dir).select("row_id", F.explode(bundles.fhir_resources(F.col("record"))).alias("j"))
    get = lambda p: F.get_json_object("j", p)
    return rows.select("row_id", get("$.resourceType").alias("kind"), F.coalesce(get("$.code.text"), get("$.medicationCodeableConcept.text")).alias("text"))


@query(f"""WITH {_FACTS} SELECT row_id, CAST(count(*) FILTER (CASE resource WHEN 'conditions' THEN row_id % 5 = 0 WHEN 'medications' THEN row_id % 7 = 0 WHEN 'allergies' THEN row_id % 4 = 0 WHEN 'vitals' THEN row_id % 3 = 0 OR row_id % 11 = 0 ELSE row_id % 6 = 0 END) AS INT) AS n_errors FROM facts GROUP BY row_id""")
def fhir_validity(spark, sf_dir):
    """Errors of records that have a month that isn't one, an empty text, an unknown code, no unit, and a date in another form."""
    row, r = F.col("row_id"), lambda name: F.col(f"record.{name}")
    odd = {
        "conditions": F.transform(r("conditions"), lambda c: c.withField("onset_date", F.when(row % 5 == 0, "2020-13-01").when(row % 5 == 1, "2020-02"))),
        "medications": F.transform(r("medications"), lambda m: m.withField("medication_text", F.when(row % 7 == 0, " ").otherwise(m["medication_text"]))),
        "allergies": F.transform(r("allergies"), lambda a: a.withField("criticality", F.when(row % 4 == 0, "severe").when(row % 4 == 1, "high"))),
        "vitals": F.transform(r("vitals"), lambda v: v.withField("unit", F.when(row % 3 == 0, "").otherwise(v["unit"])).withField("loinc_code", F.when(row % 11 == 0, "1-1").otherwise(v["loinc_code"]))),
        "procedures": F.transform(r("procedures"), lambda p: p.withField("performed_date", F.when(row % 6 == 0, "02/03/2020").otherwise("2020-02-03T10:00:00"))),
    }
    spoilt = records(spark, sf_dir).select("row_id", F.struct(*[odd[n].alias(n) for n in S.RESOURCES]).alias("record"))
    return spoilt.select("row_id", F.size(bundles.fhir_errors(F.col("record"))).alias("n_errors"))


_MODELS = ("notes-lora", "notes-qlora", "notes-v2", "notes-v2-100", "Org/base model", "")
_RESULTS = "results AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'regex' ELSE 'llm' END AS system, [" + ", ".join(f"'{m}'" for m in _MODELS) + "][p_partkey % 6 + 1] AS model, CASE WHEN p_size % 2 = 0 THEN 0 ELSE 5 END AS shots, p_size % 3 = 0 AS constrained, p_size % 5 > 0 AS schema_hint, 'test' AS split FROM part)"


def _results(spark, sf_dir):
    models = F.array(*map(F.lit, _MODELS))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, "regex").otherwise("llm").alias("system"), F.element_at(models, (F.col("p_partkey") % 6 + 1).cast("int")).alias("model"), F.when(F.col("p_size") % 2 == 0, 0).otherwise(5).alias("shots"), (F.col("p_size") % 3 == 0).alias("constrained"), (F.col("p_size") % 5 > 0).alias("schema_hint"), F.lit("test").alias("split"))


@query(f"WITH {_RESULTS} SELECT p_partkey, concat_ws('_', system, CASE WHEN system <> 'regex' AND model <> '' THEN regexp_replace(model, '[^A-Za-z0-9._-]', '-', 'g') END, shots || 'shot', CASE WHEN constrained THEN 'constrained' END, CASE WHEN NOT schema_hint THEN 'noschema' END, split) AS tag FROM results")
def result_tags(spark, sf_dir):
    return _results(spark, sf_dir).select("p_partkey", report.result_tag().alias("tag"))


_SCORED = "scored AS (SELECT system, CASE WHEN system <> 'regex' AND model <> '' THEN model END AS model, shots, constrained, schema_hint, split, count(*) AS n, round(avg(p_size) / 50, 4) AS micro_f1 FROM results GROUP BY ALL)"


def _scored(spark, sf_dir):
    model = F.when((F.col("system") != "regex") & (F.col("model") != ""), F.col("model"))
    rows = _results(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").withColumn("model", model)
    rows = rows.groupBy("system", "model", "shots", "constrained", "schema_hint", "split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_size") / 50, 4).alias("micro_f1"))
    return rows.withColumn("scored_resources", F.array(F.lit("conditions"), F.lit("vitals"))).withColumn("per_resource", F.create_map(F.lit("vitals"), F.col("micro_f1")))


@query(f"WITH {_RESULTS.replace('AS split FROM part', 'AS split, p_size FROM part')}, {_SCORED} SELECT system, model, shots, constrained, schema_hint, n, micro_f1, micro_f1 AS vitals, 'conditions,vitals' AS scored FROM scored")
def result_files(spark, sf_dir):
    """Results written as one file each, in folders by tag, and read back."""
    at = files.scratch(spark)
    rows = _scored(spark, sf_dir)
    report.write_result(rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in S.RESULT.fields]), at)
    back = files.results(spark, at)
    return back.select("system", "model", "shots", "constrained", "schema_hint", "n", "micro_f1", F.col("per_resource")["vitals"].alias("vitals"), F.array_join("scored_resources", ",").alias("scored"))


_KEY = "CASE WHEN system = 'regex' THEN 'regex' WHEN contains(lower(model), 'qlora') THEN 'tuned-4bit' WHEN contains(lower(model), 'v2') THEN CASE WHEN regexp_matches(lower(model), '-[0-9]+$') THEN 'tuned-v2-' || regexp_extract(lower(model), '([0-9]+)$', 1) ELSE 'tuned-v2' END WHEN contains(lower(model), 'lora') THEN 'tuned' ELSE 'base-' || shots || CASE WHEN constrained THEN '-constr' ELSE '' END END"


@query(f"WITH {_RESULTS}, k AS (SELECT {_KEY} AS key, * FROM results) SELECT key, max(p_partkey) AS p_partkey, arg_max(model, p_partkey) AS model FROM k GROUP BY key")
def last_wins(spark, sf_dir):
    keyed = _results(spark, sf_dir).withColumn("key", report.row_key())
    return report.last_wins(keyed.select("key", "p_partkey", "model"), "key", "p_partkey")


@query("SELECT row_id, max(v) FILTER (s = 'tuned') AS tuned, max(v) FILTER (s = 'base') AS base FROM (SELECT l_orderkey AS row_id, CASE WHEN l_linenumber % 2 = 1 THEN 'tuned' ELSE 'base' END AS s, l_quantity AS v FROM lineitem) GROUP BY row_id")
def pivot_systems(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.when(F.col("l_linenumber") % 2 == 1, "tuned").otherwise("base").alias("s"), F.col("l_quantity").alias("v")).groupBy("row_id", "s").agg(F.max("v").alias("v"))
    return stats.pivot_systems(rows, "row_id", "s", "v", ("tuned", "base"))


_SUMMARY = {"diagnosis": _LIST, "comorbidities": "p_brand", "pharmacological_therapy": "CASE WHEN p_size % 2 = 0 THEN 'NA' ELSE concat(p_type, ';', p_brand) END", "interventional_therapy": "' '", "diagnostic_techniques_procedures": "p_type"}
_SPLIT = "CASE WHEN lower(trim({0})) IN ('', 'n/a', 'na', 'none', 'not applicable') THEN [] ELSE list_filter(list_transform(string_split({0}, ';'), lambda x: trim(x)), lambda x: x <> '') END"


@query("WITH s AS (SELECT p_partkey, " + ", ".join(f"{v} AS {k}" for k, v in _SUMMARY.items()) + " FROM part) SELECT CASE WHEN p_partkey % 3 = 0 THEN 'None' ELSE CAST(p_partkey AS VARCHAR) END AS patient_id, " + ", ".join("array_to_string(list_concat([], " + ", ".join(_SPLIT.format(f) for f in fs) + f"), '|') AS {r}" for r, fs in S.EXTERNAL_FIELDS.items()) + " FROM s")
def external_records(spark, sf_dir):
    summary = F.struct(*[F.expr(v).alias(k) for k, v in _SUMMARY.items()]).alias("summary")
    rows = table(spark, sf_dir, "part").select(F.lit("").alias("patient_uid"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey")).alias("patient_id"), F.col("p_name").alias("report"), summary)
    texts = lambda r, f: F.array_join(F.transform(f"label.{r}", lambda x: x[f]), "|").alias(r)
    return external.pairs(rows).select("patient_id", texts("conditions", "code_text"), texts("medications", "medication_text"), texts("procedures", "code_text"))


@query(f"""WITH {_FACTS}, firsts AS (SELECT o_custkey, min(CAST(o_orderkey AS VARCHAR)) AS e FROM orders GROUP BY o_custkey),
homes AS (SELECT orders.o_custkey, CASE WHEN resource = 'allergies' THEN e ELSE CAST(o_orderkey AS VARCHAR) END AS encounter_id, resource, text, value FROM orders JOIN facts ON row_id = o_orderkey JOIN firsts ON firsts.o_custkey = orders.o_custkey),
said AS (SELECT o_custkey, encounter_id, resource, CASE WHEN resource = 'vitals' THEN printf('%.1f', value) ELSE text END AS what FROM homes UNION ALL SELECT o_custkey, encounter_id, resource, printf('%.1f', value + 10) FROM homes WHERE resource = 'vitals' AND value % 2 = 1)
SELECT CAST(said.o_custkey AS VARCHAR) AS patient_id, encounter_id, strftime(o_orderdate, '%Y-%m-%d') AS encounter_date, CAST(greatest(0, year(o_orderdate) - 1960) AS INT) AS age,
{", ".join(f"coalesce(string_agg(what, '|' ORDER BY what) FILTER (resource = '{r}'), '') AS {r}" for r in S.RESOURCES)} FROM said JOIN orders ON CAST(o_orderkey AS VARCHAR) = encounter_id GROUP BY ALL""")
def bundle_roundtrip(spark, sf_dir):
    """Each customer's orders as one FHIR bundle in JSON, read back into encounters: all facts, allergies at the first encounter, odd values as panels."""
    f = facts(spark, sf_dir)
    ref = F.when(F.col("resource") != "allergies", F.struct(F.concat(F.lit("urn:uuid:"), F.col("row_id").cast("string")).alias("reference")))
    is_ = lambda r, c: F.when(F.col("resource") == r, c)
    codes = lambda code: F.array(F.struct(F.lit(code).alias("code")))
    amount = lambda v: F.struct(v.alias("value"), F.lit("u").alias("unit"))
    kinds = {"conditions": "Condition", "medications": "MedicationRequest", "allergies": "AllergyIntolerance", "vitals": "Observation", "procedures": "Procedure"}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("resource")]
    panel = F.col("value") % 2 == 1
    part = lambda code, v: F.struct(F.struct(codes(code).alias("coding")).alias("code"), amount(v).alias("valueQuantity"))
    no_code, no_text = F.lit(None).cast("array<struct<code:string>>"), F.lit(None).cast("string")
    one = F.struct(
        kind.alias("resourceType"), ref.alias("encounter"),
        is_("vitals", F.struct(no_text.alias("text"), F.when(panel, codes("85354-9")).otherwise(codes("8867-4")).alias("coding"))).when(F.col("resource") != "medications", F.struct(F.col("text").alias("text"), no_code.alias("coding"))).alias("code"),
        is_("medications", F.struct("text")).alias("medicationCodeableConcept"), F.when((F.col("resource") == "vitals") & ~panel, amount(F.col("value"))).alias("valueQuantity"),
        F.when((F.col("resource") == "vitals") & panel, F.array(part("8480-6", F.col("value")), part("8462-4", F.col("value") + 10))).alias("component"),
        no_text.alias("id"), F.lit(None).cast("struct<start:string>").alias("period"), no_text.alias("birthDate"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("start"))
    bare = F.from_json(F.lit("{}"), f.select(one.alias("r")).schema["r"].dataType)
    visits = orders.select("o_custkey", F.struct("o_orderkey", F.lit(0).alias("pos")).alias("at"), bare.withField("resourceType", F.lit("Encounter")).withField("id", F.col("o_orderkey").cast("string")).withField("period", F.struct("start")).alias("r"))
    said = f.join(orders, F.col("row_id") == F.col("o_orderkey")).select("o_custkey", F.struct("o_orderkey", F.col("pos").cast("int").alias("pos")).alias("at"), one.alias("r"))
    people = orders.select("o_custkey").distinct().select("o_custkey", F.struct(F.lit(None).cast("long").alias("o_orderkey"), F.lit(0).alias("pos")).alias("at"), bare.withField("resourceType", F.lit("Patient")).withField("id", F.col("o_custkey").cast("string")).withField("birthDate", F.lit("1960-05-05")).alias("r"))
    entry = F.transform(F.array_sort(F.collect_list(F.struct("at", "r")), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)), lambda s: F.struct(s["r"].alias("resource")))
    docs = visits.unionByName(said).unionByName(people).groupBy("o_custkey").agg(F.to_json(F.struct(entry.alias("entry"))).alias("body"))
    read = bundles.encounters(files.bundles_of(docs, "o_custkey", "body"))
    names = {"conditions": "code_text", "medications": "medication_text", "allergies": "substance_text", "procedures": "code_text"}
    told = lambda r: F.transform(f"record.{r}", lambda x: text.printf_tenth(x["value"]) if r == "vitals" else x[names[r]])
    return read.select("patient_id", "encounter_id", "encounter_date", "age", *[F.array_join(F.array_sort(told(r)), "|").alias(r) for r in S.RESOURCES])


@query(
    f"""WITH notes AS (SELECT l_orderkey, l_linenumber, {_NOTE} AS note FROM lineitem), found AS ({_sql_vitals()}),
sides AS (SELECT concat(l_orderkey, ':', l_linenumber) AS row_id, loinc_code || '=' || printf('%.1f', CAST(v AS DOUBLE)) AS key, 1 AS p, 0 AS g FROM found UNION ALL SELECT concat(l_orderkey, ':', l_linenumber), '8867-4=' || printf('%.1f', l_linenumber + 50.0::DOUBLE), 0, 1 FROM notes),
keyed AS (SELECT row_id, key, sum(p) AS p, sum(g) AS g FROM sides GROUP BY ALL),
rows AS (SELECT row_id, sum(least(p, g)) AS tp, sum(p - least(p, g)) AS fp, sum(g - least(p, g)) AS fn FROM keyed GROUP BY row_id),
f AS (SELECT round(CAST(2.0 * sum(tp) / (2.0 * sum(tp) + sum(fp) + sum(fn)) AS DOUBLE), 4) AS f1 FROM rows)
SELECT count(*) AS n, (SELECT f1 FROM f) AS micro_f1, (SELECT f1 FROM f) AS macro_f1, 1.0::DOUBLE AS schema_validity, 0.0::DOUBLE AS hallucination_rate, round(avg(fn), 4) AS omission_rate FROM rows"""
)
def extraction_eval(spark, sf_dir):
    """The pattern baseline against gold vital signs, end to end: notes, prediction, counts, one result row."""
    notes = _notes(spark, sf_dir).select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("row_id"), "note", F.struct(F.array(F.struct(F.lit("8867-4").alias("loinc_code"), F.lit("").alias("display"), (F.col("l_linenumber") + 50).cast("double").alias("value"), F.lit("/min").alias("unit"))).alias("vitals"), *[F.array().cast(S.RECORD[r].dataType).alias(r) for r in S.RESOURCES if r != "vitals"]).alias("label"))
    label = F.struct(*[F.col(f"label.{r}").alias(r) for r in S.RESOURCES]).cast(S.RECORD)
    guess = F.struct(*[(text.vitals_in(F.col("note")) if r == "vitals" else F.array().cast(S.RECORD[r].dataType)).alias(r) for r in S.RESOURCES]).cast(S.RECORD)
    rows = notes.select("row_id", "note", label.alias("label"), guess.alias("guess"))
    counts = scoring.exact_counts(bundles.long_facts(rows, "guess", "row_id"), bundles.long_facts(rows, "label", "row_id"), "row_id")
    scored = scoring.row_scores(counts, "row_id").withColumn("schema_valid", F.lit(True)).withColumn("hallucinated", F.lit(0))
    return scoring.aggregate(scored).drop("per_resource")
