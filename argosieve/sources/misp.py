"""Events in the MISP JSON format as indicator entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argosieve.sources.feeds import quote

_TAGS = "Tag array<struct<name:string, colour:string, exportable:string>>"
_ATTRIBUTE = f"array<struct<uuid:string, type:string, value:string, category:string, to_ids:string, comment:string, timestamp:string, object_relation:string, {_TAGS.replace('Tag ', 'Tag:', 1)}>>"
SCHEMA = (
    "Event struct<uuid:string, info:string, threat_level_id:string, analysis:string, date:string, timestamp:string, published:string, Orgc:struct<uuid:string, name:string>, "
    + _TAGS.replace("Tag ", "Tag:", 1)
    + f", Attribute:{_ATTRIBUTE}, Object:array<struct<uuid:string, name:string, `meta-category`:string, description:string, comment:string, timestamp:string, Attribute:{_ATTRIBUTE}>>>"
)
_IGNORED = ("comment", "text", "other", "link", "datetime", "size-in-bytes", "counter", "float", "hex", "port", "attachment", "malware-sample")
_ADDRESS = ("ip-src", "ip-dst", "ip", "ip-src/netmask", "ip-dst/netmask")
_WITH_PORT = ("ip-src|port", "ip-dst|port")
_FILE_HASH = tuple(f"filename|{h}" for h in ("md5", "sha1", "sha256", "sha384", "sha512", "imphash", "ssdeep", "tlsh", "authentihash", "vhash", "pehash", "impfuzzy"))
_ALWAYS = (
    "domain hostname md5 sha1 sha224 sha256 sha384 sha512 sha512/224 sha512/256 sha3-224 sha3-256 sha3-384 sha3-512 ssdeep imphash tlsh authentihash vhash cdhash pehash impfuzzy telfhash filename filename-pattern email email-src email-dst "
    "email-reply-to email-subject email-body user-agent http-method mac-address mac-eui-64 AS btc xmr dash yara snort sigma pattern-in-file pattern-in-traffic pattern-in-memory mutex regkey regkey|value"
).split() + ["named pipe"]


def url_host(url: Column) -> Column:
    """The host of a URL: behind ``://``, up to the first slash, else ``?``, else ``#``, and without a port."""
    rest = F.when(url.contains("://"), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(url)
    host = F.when(rest.contains("/"), F.substring_index(rest, "/", 1)).when(rest.contains("?"), F.substring_index(rest, "?", 1)).otherwise(F.substring_index(rest, "#", 1))
    return F.regexp_replace(host, r":\d*$", "")


def read_events(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row an event; files that hold none (manifests and the like) are left out, and no event at all is an error."""
    raw = spark.read.json(paths, schema=SCHEMA, multiLine=True).withColumn("file", F.input_file_name())
    events = raw.filter(F.col("Event").isNotNull() & (F.coalesce("Event.uuid", "Event.info").isNotNull() | F.col("Event.Attribute").isNotNull() | F.col("Event.Object").isNotNull()) & ~F.col("file").rlike(r"(manifest\.json|hashes\.csv)$"))
    if events.isEmpty():
        raise ValueError("no file holds an event")
    return events


def _tag_names(tags: Column) -> Column:
    return F.filter(F.transform(F.coalesce(tags, F.array().cast("array<struct<name:string,colour:string,exportable:string>>")), lambda t: t["name"]), lambda n: n.isNotNull())


def attributes(events: DataFrame) -> DataFrame:
    """One row an attribute: the event's fields, the object's name and comment, and ``a``, the attribute.

    Events are read once. Those of one event follow each other, its own before those of its objects.
    """
    none = F.lit(None).cast("string")
    row = lambda a, name, comment: F.struct(a.alias("a"), name.alias("object_type"), comment.alias("object_comment"))
    plain = F.transform("Event.Attribute", lambda a: row(a, none, none))
    inner = lambda o: F.transform(o["Attribute"], lambda a: row(a, o["name"], o["comment"]))
    objects = F.flatten(F.filter(F.transform("Event.Object", inner), lambda x: x.isNotNull()))
    return events.select("Event.*", F.explode(F.concat(F.coalesce(plain, F.array()), F.coalesce(objects, F.array()))).alias("r")).select("*", "r.*").drop("r", "Attribute", "Object")


def _named(n: Column, names: dict[str, str], other: str) -> Column:
    number = n.try_cast("int").cast("string")
    out = F.when(number.isNull(), F.lit(None).cast("string"))
    for k, v in names.items():
        out = out.when(number == k, F.lit(v))
    return out.otherwise(F.lit(other))


def _object(pairs: dict[str, Column]) -> Column:
    parts = [F.concat(quote(F.lit(k)), F.lit(":"), v) for k, v in sorted(pairs.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _text(c: Column) -> Column:
    return F.when(c.isNotNull(), quote(c))


def _payload(mode: str) -> Column:
    a = F.col("a")
    event_tags, own_tags = _tag_names(F.col("Tag")), _tag_names(a["Tag"])
    tags = F.concat(event_tags, own_tags)
    joined = F.when(F.size(tags) > 0, quote(F.array_join(tags, ",")))
    level = _named(F.col("threat_level_id"), {"1": "High", "2": "Medium", "3": "Low"}, "Undefined")
    comment = F.when(F.coalesce(a["comment"], F.lit("")) != "", a["comment"])
    if mode == "minimal":
        return _object({"threat_level": _text(level), "tags": joined, "type": _text(a["type"])})
    if mode == "full":
        return _object(
            {
                "event_info": _text(F.col("info")), "event_uuid": _text(F.col("uuid")), "threat_level": _text(level), "analysis": _text(_named(F.col("analysis"), {"0": "Initial", "1": "Ongoing", "2": "Complete"}, "Unknown")), "event_date": _text(F.col("date")),
                "org_name": _text(F.col("Orgc.name")), "tags": joined, "object_type": _text(F.col("object_type")), "object_comment": _text(F.col("object_comment")), "type": _text(a["type"]), "category": _text(a["category"]),
                "to_ids": F.when(F.lower(a["to_ids"]).isin("true", "1"), "true").when(F.lower(a["to_ids"]).isin("false", "0"), "false"), "comment": _text(comment),
            }
        )
    if mode != "threatdb":
        raise ValueError(f"unknown metadata mode: {mode}")
    marking = lambda t: (
        F.when(F.lower(t).isin("tlp:white", "tlp:clear"), "CLEAR").when(F.lower(t) == "tlp:green", "GREEN").when(F.lower(t) == "tlp:amber", "AMBER").when(F.lower(t) == "tlp:amber+strict", "AMBER+STRICT").when(F.lower(t) == "tlp:red", "RED")
    )
    tlp = F.try_element_at(F.filter(F.transform(tags, marking), lambda x: x.isNotNull()), F.lit(1))
    threat = F.coalesce(_named(F.col("threat_level_id"), {"1": "high", "2": "medium", "3": "low"}, "unknown"), F.lit("unknown"))
    return _object(
        {
            "threat_level": _text(threat), "source": _text(F.coalesce("Orgc.name", F.lit("misp-import"))), "description": _text(F.coalesce(F.col("info"), comment)), "first_seen": _text(F.concat("date", F.lit("T00:00:00Z"))),
            "tags": F.when(F.size(tags) > 0, F.to_json(tags)), "tlp": _text(tlp), "indicator_type": _text(a["type"]), "category": _text(F.coalesce(a["category"], F.lit("Other"))),
        }
    )


def entries(events: DataFrame, mode: str = "full") -> DataFrame:
    """Entries (seq, key, kind, data_json) of the events' attributes; ``mode`` is full, minimal or threatdb.

    An attribute's type tells what it gives: an address, the address before a port, a string, a host and a URL, or the two
    halves of a composite. Values that are blank, null, arrays or objects give nothing, nor do types that can't be matched;
    unknown types give a string if it has fewer than 1000 bytes. No value becomes a glob.
    """
    rows = attributes(events)
    kind, raw = F.col("a.type"), F.col("a.value")
    value = F.when(raw.startswith("{") | raw.startswith("["), F.lit("")).otherwise(F.coalesce(raw, F.lit("")))
    before, after = F.substring_index(value, "|", 1), F.regexp_replace(value, r"(?s)^[^|]*\|", "")
    one = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("key"))
    pipe = value.contains("|")
    none = F.array().cast("array<struct<kind:string,key:string>>")
    host = url_host(value)
    keys = (
        F.when(F.trim(value) == "", none)
        .when(kind.isin(*_ADDRESS), F.array(one("ip", value)))
        .when(kind.isin(*_WITH_PORT), F.when(pipe, F.array(one("ip", before))).otherwise(none))
        .when(kind == "domain|ip", F.when(pipe, F.array(one("literal", before), one("ip", after))).otherwise(none))
        .when(kind.isin("url", "uri"), F.when(host != "", F.array(one("literal", host), one("literal", value))).otherwise(F.array(one("literal", value))))
        .when(kind.isin(*_FILE_HASH), F.when(pipe, F.array(one("literal", before), one("literal", after))).otherwise(none))
        .when(kind.isin(*_ALWAYS), F.array(one("literal", value)))
        .when(kind.isin(*_IGNORED), none)
        .when(F.octet_length(value) < 1000, F.array(one("literal", value)))
        .otherwise(none)
    )
    out = rows.select(_payload(mode).alias("data_json"), F.explode(keys).alias("key"))
    return out.select(F.monotonically_increasing_id().alias("seq"), F.col("key.key").alias("key"), F.col("key.kind").alias("kind"), "data_json")


def misp_feed(spark: SparkSession, paths: str | list[str], mode: str = "full") -> DataFrame:
    return entries(read_events(spark, paths), mode)


def import_stats(events: DataFrame) -> DataFrame:
    """How many events, attributes, and attributes of objects there are."""
    rows = attributes(events)
    a = rows.agg(F.count(F.lit(1)).alias("attributes"), F.count("object_type").alias("object_attributes"))
    return events.agg(F.count(F.lit(1)).alias("events")).crossJoin(a)
