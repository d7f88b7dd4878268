"""Policy documents in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net
from ..functions.text import parse_duration_ms, parse_magnitude, render_duration
from ..functions.vocab import literal_map
from ..session import cut_lineage

# Built-in defaults, used where neither the policy nor the document says.
DEFAULTS = {"cooldown": "0s", "holdDown": "0s", "eventUpdateInterval": "60s", "severity": "major",
            "executionMode": "alertOnly", "clearPercent": 80}
SCHEMA_VERSION = 1

# Thresholds are magnitudes: numbers or texts. JSON numbers read as text here.
_SELECTOR = "STRUCT<kind: STRING, addr: STRING, prefixLen: INT, name: STRING>"
_ENTRY = (
    "id: STRING, name: STRING, description: STRING, enabled: BOOLEAN, tenant: STRING, scopeType: STRING, "
    f"selector: {_SELECTOR}, addressFamily: STRING, direction: STRING, window: STRING, "
    "thresholds: MAP<STRING, STRING>, clearPercent: INT, triggerFor: STRING, clearFor: STRING, cooldown: STRING, "
    "holdDown: STRING, eventUpdateInterval: STRING, severity: STRING, executionMode: STRING, priority: INT, "
    "labels: MAP<STRING, STRING>, version: BIGINT"
)
DOCUMENT_SCHEMA = (
    "schemaVersion INT, defaults STRUCT<cooldown: STRING, holdDown: STRING, eventUpdateInterval: STRING, "
    "severity: STRING, executionMode: STRING, clearPercent: INT>, "
    f"tenants ARRAY<STRUCT<tenant: STRING, prefixes: ARRAY<STRING>>>, policies ARRAY<STRUCT<{_ENTRY}>>"
)
FAMILIES = {"ipv4": 4, "ipv6": 6}
DOCUMENT_FIELDS = ["schemaVersion", "defaults", "tenants", "policies"]
POLICY_FIELDS = [
    "id", "name", "description", "enabled", "tenant", "scopeType", "selector", "addressFamily", "direction", "window", "thresholds", "clearPercent",
    "triggerFor", "clearFor", "cooldown", "holdDown", "eventUpdateInterval", "severity", "executionMode", "priority", "labels", "version",
]
SELECTOR_FIELDS = ["kind", "addr", "prefixLen", "name"]
DEFAULT_FIELDS = list(DEFAULTS)
TENANT_FIELDS = ["tenant", "prefixes"]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents as they are, each with the file it stands in; malformed JSON is an error.

    ``document_error`` is the first thing the document itself gets wrong,
    ``raw`` has each policy's fields as text, from which unknown ones are told.
    """
    return parse_documents(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source")))


def parse_documents(texts: DataFrame, column: str = "value") -> DataFrame:
    """The same for documents that are a text each; a column ``source`` names them."""
    none = _texts([]).cast("array<string>")
    fields = lambda text, known: F.coalesce(F.array_except(F.map_keys(F.from_json(text, "MAP<STRING, STRING>")), _texts(known)), none)
    inner = lambda name, found: F.transform(found, lambda field: F.concat(F.lit(f"{name}."), field))
    listed = F.from_json(F.get_json_object(column, "$.tenants"), "ARRAY<MAP<STRING, STRING>>")
    tenants = F.coalesce(F.flatten(F.transform(listed, lambda entry: F.coalesce(F.array_except(F.map_keys(entry), _texts(TENANT_FIELDS)), none))), none)
    unknown = F.concat(fields(F.col(column), DOCUMENT_FIELDS), inner("defaults", fields(F.get_json_object(column, "$.defaults"), DEFAULT_FIELDS)), inner("tenants", tenants))
    version = F.col("d.schemaVersion")
    error = F.when(version.isNull(), F.lit("missing_field:schemaVersion")).when(version != SCHEMA_VERSION, F.concat(F.lit("unsupported_schema:"), version)).when(
        F.size("unknown") > 0, F.concat(F.lit("unknown_field:"), F.element_at("unknown", 1))).when(F.col("d.policies").isNull(), F.lit("missing_field:policies"))
    return texts.select(
        F.from_json(column, DOCUMENT_SCHEMA, {"mode": "FAILFAST"}).alias("d"), unknown.alias("unknown"),
        F.from_json(F.get_json_object(column, "$.policies"), "ARRAY<MAP<STRING, STRING>>").alias("raw"),
        (F.col("source") if "source" in texts.columns else F.lit(None).cast("string")).alias("source"),
    ).select("d.*", "raw", "source", error.alias("document_error"))


def _texts(values):
    return F.array(*[F.lit(value) for value in values])


def source_error():
    """The first thing a policy's document or its own text gets wrong, with the field's name; NULL when nothing is."""
    unknown = F.concat(
        F.array_except(F.coalesce(F.map_keys("raw"), _texts([]).cast("array<string>")), _texts(POLICY_FIELDS)),
        F.transform(F.array_except(F.coalesce(F.map_keys(F.from_json(F.element_at("raw", "selector"), "MAP<STRING, STRING>")), _texts([]).cast("array<string>")), _texts(SELECTOR_FIELDS)),
                    lambda name: F.concat(F.lit("selector."), name)))
    error = F.when(F.col("document_error").isNotNull(), F.col("document_error")).when(F.size(unknown) > 0, F.concat(F.lit("unknown_field:"), F.element_at(unknown, 1)))
    for field in ("window", "triggerFor", "clearFor"):
        error = error.when(F.col(f"p.{field}").isNull(), f"missing_field:{field}").when(parse_duration_ms(F.col(f"p.{field}")).isNull(), f"bad_duration:{field}")
    for field in ("cooldown", "holdDown", "eventUpdateInterval"):
        given = F.coalesce(f"p.{field}", f"defaults.{field}")
        error = error.when(given.isNotNull() & parse_duration_ms(given).isNull(), f"bad_duration:{field}")
    bad = F.filter(F.map_entries("p.thresholds"), lambda e: parse_magnitude(e["value"]).isNull())
    return error.when(F.coalesce(F.size(bad) > 0, F.lit(False)), F.concat(F.lit("bad_magnitude:"), F.element_at(F.transform(bad, lambda e: e["key"]), 1)))


def policies_of(documents: DataFrame) -> DataFrame:
    """Drafts in the library's shape: policy value, else document default, else built-in.

    ``position`` is a policy's place in its document, ``source_error`` what its text
    gets wrong; such a draft fails validation and is never selected.
    """
    if "raw" not in documents.columns:
        documents = documents.withColumn("raw", F.lit(None).cast("array<map<string,string>>"))
    for name in ("source", "document_error"):
        if name not in documents.columns:
            documents = documents.withColumn(name, F.lit(None).cast("string"))
    # Each policy goes along with its own texts; a row that held those of the whole document would be as large as it.
    paired = documents.select("defaults", "source", "document_error", "policies", F.coalesce("raw", F.array().cast("array<map<string,string>>")).alias("raw"))
    each = paired.select("defaults", "source", "document_error", F.posexplode(F.arrays_zip("policies", "raw")).alias("position", "e"))
    each = each.select("defaults", "source", "document_error", "position", F.col("e.policies").alias("p"), F.col("e.raw").alias("raw"))
    each = each.withColumn("source_error", source_error()).drop("raw")

    def pick(field: str):
        return F.coalesce(F.col(f"p.{field}"), F.col(f"defaults.{field}"), F.lit(DEFAULTS[field]))

    address = F.inline_outer(F.array(net.parse_address(F.col("p.selector.addr"))))
    each = each.select("*", address.alias("sel_family", "sel_hi", "sel_lo"))
    kind = F.coalesce(F.col("p.selector.kind"), F.lit("any"))
    sel_len = F.when(kind == "network", F.col("p.selector.prefixLen")).when(kind == "host", net.width(F.col("sel_family")))
    return each.select(
        F.col("p.id").alias("policy_id"), F.col("p.name").alias("name"), F.col("p.description").alias("description"),
        F.coalesce("p.enabled", F.lit(True)).alias("enabled"), F.col("p.tenant").alias("tenant"),
        F.col("p.scopeType").alias("scope_type"), kind.alias("selector"),
        "sel_family", "sel_hi", "sel_lo", sel_len.cast("int").alias("sel_len"), F.col("p.selector.name").alias("sel_hostgroup"),
        F.element_at(literal_map(FAMILIES), F.col("p.addressFamily")).alias("family"), F.col("p.direction").alias("direction"),
        parse_duration_ms(F.col("p.window")).alias("window_ms"),
        F.transform_values("p.thresholds", lambda _, v: parse_magnitude(v)).alias("thresholds"),
        pick("clearPercent").alias("clear_percent"),
        parse_duration_ms(F.col("p.triggerFor")).alias("trigger_for_ms"), parse_duration_ms(F.col("p.clearFor")).alias("clear_for_ms"),
        parse_duration_ms(pick("cooldown")).alias("cooldown_ms"), parse_duration_ms(pick("holdDown")).alias("hold_down_ms"),
        parse_duration_ms(pick("eventUpdateInterval")).alias("event_update_ms"),
        pick("severity").alias("severity"), pick("executionMode").alias("mode"), F.coalesce("p.priority", F.lit(0)).alias("priority"),
        F.coalesce("p.labels", F.create_map().cast("map<string,string>")).alias("labels"),
        F.coalesce("p.version", F.lit(1).cast("bigint")).alias("version"), "position", "source_error", "source", "document_error",
    )


def tenant_prefixes_of(documents: DataFrame) -> DataFrame:
    """(tenant, family, net_hi, net_lo, prefix_len) of the ownership lists."""
    each = documents.select(F.explode("tenants").alias("t")).select("t.tenant", F.explode("t.prefixes").alias("text"))
    return each.select("tenant", F.inline(F.array(net.parse_cidr(F.col("text")))).alias("family", "net_hi", "net_lo", "prefix_len"))


def read_policies(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Policies of a document or a folder of them; a strict read refuses what is wrong, naming every file, position and field."""
    documents = read_documents(spark, path)
    drafts = policies_of(documents)
    if not strict:
        return drafts
    whole = documents.where("document_error IS NOT NULL").orderBy("source").select("source", "document_error").collect()
    bad = drafts.where("source_error IS NOT NULL AND NOT source_error <=> document_error").orderBy("source", "position").select(
        "source", "position", "policy_id", "source_error").collect()
    if whole or bad:
        faults = [f"{r['source']}: {r['document_error']}" for r in whole] + [f"{r['source']}: {r['policy_id']} at {r['position']}: {r['source_error']}" for r in bad]
        raise ValueError("policies: " + "; ".join(faults))
    return drafts.drop("position", "source_error", "document_error", "source")


def to_documents(policies: DataFrame) -> DataFrame:
    """Each policy as one JSON entry, durations in their shortest exact unit."""
    kind = F.col("selector")
    text = net.address_text(F.col("sel_family"), F.col("sel_hi"), F.col("sel_lo"))
    selector = F.struct(
        kind.alias("kind"), F.when(kind.isin("host", "network"), text).alias("addr"),
        F.when(kind == "network", F.col("sel_len")).alias("prefixLen"), F.when(kind == "hostgroup", F.col("sel_hostgroup")).alias("name"),
    )
    spelled = {"window": "window_ms", "triggerFor": "trigger_for_ms", "clearFor": "clear_for_ms", "cooldown": "cooldown_ms",
               "holdDown": "hold_down_ms", "eventUpdateInterval": "event_update_ms"}
    entry = F.struct(
        F.col("policy_id").alias("id"), "name", "description", "enabled", "tenant", F.col("scope_type").alias("scopeType"),
        selector.alias("selector"), F.when(F.col("family").isNotNull(), F.concat(F.lit("ipv"), F.col("family"))).alias("addressFamily"),
        "direction", "thresholds", F.col("clear_percent").alias("clearPercent"),
        *[render_duration(F.col(c)).alias(name) for name, c in spelled.items()],
        "severity", F.col("mode").alias("executionMode"), "priority", "labels", "version",
    )
    return policies.select("policy_id", F.to_json(entry).alias("entry"))


ROWS_A_TASK, DOCUMENTS_A_TASK = 10_000, 250  # a task's files are told apart by three digits


def write_policies(policies: DataFrame, path: str, per_document: int = 10_000) -> None:
    """A folder of documents that ``read_policies`` reads as one set, ordered by policy id within and between its files.

    Sets of up to ``per_document`` policies are one document; larger ones are cut into documents of that many, also
    between policies of one id, one policy a line. A task writes a range of ids: one large document or many small
    ones, the last of which may be short. No policies make one document without any.
    """
    entries = cut_lineage(to_documents(policies))
    rows = entries.count()
    a_task = per_document * min(max(ROWS_A_TASK // per_document, 1), DOCUMENTS_A_TASK)
    head, tail = '{"schemaVersion":%d,"policies":[' % SCHEMA_VERSION, "]}"
    if not rows:
        entries.sparkSession.range(1).select(F.lit(head + tail).alias("value")).coalesce(1).write.mode("overwrite").text(path)
        return
    tasks = 1 if rows <= per_document else -(-rows // a_task)
    ranged = cut_lineage(entries.repartitionByRange(tasks, "policy_id", "entry").sortWithinPartitions("policy_id", "entry"))
    number = F.monotonically_increasing_id()  # the partition, and below it the row's number in 33 bits
    placed = ranged.select("entry", F.shiftright(number, 33).alias("part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    last = placed.groupBy("part").agg(F.max("row").alias("last"))  # one row a task
    place = F.col("row") % per_document
    line = F.concat(F.when(place == 0, head).otherwise(""), "entry", F.when((place == per_document - 1) | (F.col("row") == F.col("last")), tail).otherwise(","))
    placed.join(F.broadcast(last), "part").select(line.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", per_document).text(path)
