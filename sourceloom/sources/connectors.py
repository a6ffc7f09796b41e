"""Connector inputs: drive listings, chat exports, inventories."""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.functions.lets import none_if_blank
from sourceloom.sources.records import read_records

# Envelope keys of a drive listing and the field names its versions use.
ENVELOPES = ["files", "items", "entries", "result", "results", "data"]
FIELDS = {
    "file_id": ["id", "fileId"], "name": ["name", "title"], "mime_type": ["mimeType", "mime"],
    "modified": ["modifiedTime", "modified", "modifiedDate"], "size": ["size", "fileSize"],
    "md5": ["md5Checksum", "md5"], "explicit_path": ["path", "drivePath", "fullPath"],
}
FOLDER_MIME = "application/vnd.google-apps.folder"


def first_field(record: Column, names: list[str]) -> Column:
    """First non-empty of several field names of a map<string,string>."""
    return F.coalesce(*[none_if_blank(F.try_element_at(record, F.lit(n))) for n in names])


def parent_ids(raw: Column) -> Column:
    """array<string> of parents given as a string, a list of strings or a list of objects."""
    text = F.trim(raw)
    objects = F.from_json(text, "array<map<string,string>>")
    strings = F.from_json(text, "array<string>")
    return (F.when(raw.isNull() | (text == ""), F.array().cast("array<string>"))
            .when(text.startswith("[{"), F.filter(F.transform(objects, lambda o: first_field(o, ["id", "fileId"])), lambda x: x.isNotNull()))
            .when(text.startswith("["), strings).otherwise(F.array(text)))


def drive_listing(spark: SparkSession, path: str) -> DataFrame:
    """Normalised rows of listing payloads (JSON documents, any envelope), read record by record."""
    df = (read_records(spark, path, ENVELOPES).filter(F.ltrim("record").startswith("{"))
          .select(F.from_json("record", "map<string,string>").alias("r")))
    parents = F.coalesce(*[F.try_element_at("r", F.lit(k)) for k in ("parents", "parentIds", "parentId")])
    return (df.select(*[first_field(F.col("r"), names).alias(c) for c, names in FIELDS.items()], parent_ids(parents).alias("parent_ids"))
            .filter(F.col("file_id").isNotNull()).withColumn("parent_id", F.get("parent_ids", F.lit(0))))


def resolve_folder(listing: DataFrame, name: str) -> str:
    """Id of the one folder with this name; none or several is an error."""
    found = [r["file_id"] for r in listing.filter((F.col("mime_type") == FOLDER_MIME) & (F.col("name") == name))
             .select("file_id").orderBy("file_id").limit(9).collect()]
    if len(found) != 1:
        raise LookupError(f"{len(found)} folders named {name!r}: {found}")
    return found[0]


def chat_export(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(messages, users) of an export: ``<channel>/<YYYY-MM-DD>.json`` and ``users.json``, in a folder or a zip archive.

    A malformed day file, or one that is not a list, is skipped.  Archives are read where they lie.
    """
    from sourceloom.operators.chat import display_name

    def payloads(pattern: str) -> DataFrame:
        found = (read_records(spark, root, [], members=pattern) if root.endswith(".zip") else read_records(spark, f"{root}/{pattern}", []))
        return found.filter(F.col("listed") & F.col("record").startswith("{")).withColumn("file", F.coalesce("member", "path"))

    message = "ts string, user string, username string, text string, thread_ts string, files array<map<string,string>>"
    days = (payloads("*/????-??-??.json").select(
        F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("channel"), F.regexp_extract("file", r"(\d{4}-\d{2})-\d{2}\.json$", 1).alias("month"),
        F.from_json("record", message).alias("m")))
    messages = (days.select("channel", "month", "m.ts", F.coalesce("m.user", F.lit("")).alias("user"), "m.username",
                        F.coalesce("m.text", F.lit("")).alias("text"), "m.thread_ts",
                        (F.size(F.coalesce("m.files", F.array().cast("array<map<string,string>>"))) > 0).alias("has_files")))
    person = "id string, name string, profile struct<display_name: string, real_name: string>"
    users = (payloads("users.json").select(F.from_json("record", person).alias("u"))
             .select("u.id", display_name(F.col("u")).alias("display")))
    return messages, users


def load_inventory(spark: SparkSession, path: str) -> DataFrame | None:
    """Another stage's inventory file; unreadable or malformed means "no inventory", not "empty".

    Read on the driver: file readers skip names that start with an underscore, and an empty
    inventory would read as the deletion of everything.
    """
    try:
        with open(path, encoding="utf-8") as handle:
            entries = json.load(handle)["files"]
        rows = [(k, v.get("name"), v.get("localPath"), v.get("drivePath"), v.get("sourceUri"), v.get("orgUnit"),
                 v.get("mimeType"), v.get("fingerprint")) for k, v in entries.items()]
    except (OSError, ValueError, KeyError, AttributeError, TypeError):
        return None
    return spark.createDataFrame(rows, "file_id string, name string, local_path string, drive_path string, "
                                 "source_uri string, org_unit string, mime_type string, fingerprint string")
