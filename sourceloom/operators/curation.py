"""Corpus curation: classification, exact de-duplication, trimming, inventory keys."""
from __future__ import annotations

import json
import mimetypes

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourceloom.functions import paths
from sourceloom.functions.fold import path_norm
from sourceloom.functions.lets import let
from sourceloom.functions.words import COPY_MARKERS

# The default curation rules (ordered, first match wins) and trim lists.
DEFAULT_TAXONOMY = {
    "org_units": {},
    "demoted_types": ["other", "internal-admin"],
    "fallback": {"type": "other", "verdict": "MAYBE"},
    "rules": [
        {"type": "system-noise", "verdict": "OUT",
         "ext": [".ds_store", ".ini", ".tmp", ".lnk", ".url", ".localized", ".download", ".crdownload"]},
        {"type": "web-assets", "verdict": "OUT",
         "ext": [".js", ".css", ".scss", ".map", ".ttf", ".woff", ".woff2", ".eot"]},
        {"type": "meeting-minutes", "verdict": "IN",
         "basename_any": ["minutes", "meeting notes"],
         "path_any": ["board meeting", "committee", "all hands", "offsite"]},
        {"type": "reports", "verdict": "IN",
         "path_any": ["quarterly report", "monthly report", "annual report", "status report",
                      "kpi", "metrics", "dashboard", "progress update"]},
        {"type": "presentations", "verdict": "IN",
         "basename_any": ["deck", "pitch", "presentation", "teaser", "one pager", "one-pager"]},
        {"type": "product-docs", "verdict": "IN",
         "path_any": ["prd", "roadmap", "design doc", "architecture", "rfc", "postmortem"],
         "path_regex": [r"\bspec"]},
        {"type": "strategy", "verdict": "IN",
         "path_any": ["strategy", "okr", "planning", "market map", "competitive analysis"]},
        {"type": "memos", "verdict": "IN", "basename_any": ["memo", "proposal", "brief"]},
        {"type": "data-room", "verdict": "MAYBE", "path_any": ["data room", "dataroom", "due diligence"]},
        {"type": "research", "verdict": "MAYBE",
         "path_any": ["research", "benchmark", "whitepaper", "training"]},
        {"type": "legal-contracts", "verdict": "OUT",
         "path_any": ["contract", "agreement", "terms of service", "bylaws", "deed",
                      "power of attorney", "notarial", "articles of incorporation"],
         "path_regex": [r"\bnda"]},
        {"type": "finance-accounting", "verdict": "OUT",
         "path_any": ["invoice", "payroll", "accounting", "financial statements", "bookkeeping",
                      "expense", "receipts", "audit", "ledger"]},
        {"type": "tax", "verdict": "OUT", "path_any": ["tax filing", "vat return", "withholding"]},
        {"type": "hr", "verdict": "OUT",
         "path_any": ["recruiting", "resume", "onboarding", "offboarding", "performance review",
                      "employment", "payslip"]},
        {"type": "compliance", "verdict": "OUT",
         "path_any": ["kyc", "aml", "gdpr", "data protection", "compliance"]},
        {"type": "marketing-media", "verdict": "OUT",
         "path_any": ["press", "logo", "brand assets", "photos", "social media"]},
        {"type": "internal-admin", "verdict": "OUT",
         "path_any": ["office supplies", "travel booking", "catering", "facilities", "it support"]},
    ],
}
NON_DOCUMENT_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "webp", "bmp", "tif", "tiff", "heic", "svg", "eps", "ai", "psd",
    "mp4", "mov", "avi", "mkv", "wmv", "m4v", "mp3", "wav",
    "zip", "7z", "rar", "tar", "gz",
    "textclipping", "php", "ds_store", "localized", "url", "lnk", "crdownload",
]


def _any_of(words: list[str]) -> str:
    """One alternation of literals, folded like the text it is matched against."""
    import re
    import unicodedata
    plain = ("".join(c for c in unicodedata.normalize("NFD", w.lower()) if unicodedata.category(c) != "Mn")
             for w in words)
    return "|".join(re.escape(w) for w in plain)


def _rule_hit(rule: dict, norm_path: Column, norm_base: Column, ext: Column) -> Column:
    hit = F.lit(False)
    if rule.get("ext"):
        hit = hit | ext.isin([e.lower() for e in rule["ext"]])
    if rule.get("basename_any"):
        hit = hit | norm_base.rlike(_any_of(rule["basename_any"]))
    patterns = [_any_of(rule["path_any"])] if rule.get("path_any") else []
    patterns += [f"(?i:{p})" for p in rule.get("path_regex", [])]
    return hit | norm_path.rlike("|".join(patterns)) if patterns else hit


def _label(taxonomy: dict, path: Column) -> Column:
    """struct<type,verdict> of a path: ordered rules, first match wins."""
    def decide(p: Column) -> Column:
        norm_base, ext = paths.base_name(p["norm"]), paths.extension(p["path"])
        result = F.struct(F.lit(taxonomy["fallback"]["type"]).alias("type"),
                          F.lit(taxonomy["fallback"]["verdict"]).alias("verdict"))
        for rule in reversed(taxonomy["rules"]):
            result = F.when(_rule_hit(rule, p["norm"], norm_base, ext), F.struct(
                F.lit(rule["type"]).alias("type"), F.lit(rule["verdict"]).alias("verdict"))).otherwise(result)
        return result

    return let(F.struct(path.alias("path"), path_norm(path).alias("norm")), decide)


def classify(files: DataFrame, taxonomy: dict | None = None) -> DataFrame:
    """Type, verdict and unit of every file inside a folder; files at the root are skipped."""
    tax = taxonomy or DEFAULT_TAXONOMY
    unit = paths.top_folder(F.col("path"))
    if tax.get("org_units"):
        names = F.create_map(*[F.lit(x) for kv in tax["org_units"].items() for x in kv])
        unit = F.coalesce(F.try_element_at(names, unit), unit)
    return (files.filter(paths.relative(F.col("path")).contains("/"))
            .withColumn("_label", _label(tax, F.col("path")))
            .withColumns({"type": F.col("_label.type"), "verdict": F.col("_label.verdict"), "unit": unit})
            .drop("_label"))


def taxonomy_matrix(classified: DataFrame) -> DataFrame:
    """Files and bytes per type and unit."""
    return classified.groupBy("type", "unit").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def taxonomy_examples(classified: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` paths of each type (a report limit; the rank limit runs before the shuffle)."""
    ranked = classified.withColumn("rank", F.row_number().over(W.partitionBy("type").orderBy("path")))
    return ranked.filter(F.col("rank") <= n).select("type", "rank", "path")


def noise(path: Column, type_: Column, taxonomy: dict | None = None) -> Column:
    """Would the trim step drop this record?"""
    demoted = (taxonomy or DEFAULT_TAXONOMY)["demoted_types"]
    bare_ext = F.regexp_replace(paths.extension(path), r"^\.", "")
    return bare_ext.isin(NON_DOCUMENT_EXTENSIONS) | type_.isin(demoted)


def canonical_rank(path: Column, type_: Column, verdict: Column, taxonomy: dict | None = None) -> Column:
    """Lower is better: survives the trim, IN, unmarked name, shallow folder, path."""
    return F.struct(
        noise(path, type_, taxonomy).cast("int").alias("noise"),
        (verdict != "IN").cast("int").alias("not_in"),
        path.rlike(COPY_MARKERS).cast("int").alias("marked"),
        (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).alias("depth"),
        path.alias("path"))


def curate(classified: DataFrame, taxonomy: dict | None = None) -> DataFrame:
    """One record per content hash.  Empty and hash-less files are never merged.

    The winner is an aggregate minimum, so copies are combined on the map side and a hash shared
    by a third of all files costs one row per task in the shuffle.
    """
    record = ["path", "type", "verdict", "unit", "hash", "size"]
    kept = classified.filter(F.col("verdict").isin("IN", "MAYBE")).select(*record)
    groupable = F.col("hash").isNotNull() & (F.col("hash") != "") & (F.col("size") > 0)
    rank = canonical_rank(F.col("path"), F.col("type"), F.col("verdict"), taxonomy)
    payload = F.struct(rank.alias("rank"), *[F.col(c) for c in record if c not in ("path", "hash")])
    winners = (kept.filter(groupable).groupBy("hash").agg(F.min(payload).alias("w"))
               .select(F.col("w.rank.path").alias("path"), "w.type", "w.verdict", "w.unit", "hash", "w.size"))
    return winners.unionByName(kept.filter(~F.coalesce(groupable, F.lit(False))))


def duplicate_groups(files: DataFrame, hash_col: str = "hash") -> DataFrame:
    """Content shared by several files: group size, bytes a curated corpus no longer stores."""
    return (files.filter(F.col("size") > 0).groupBy(hash_col)
            .agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path"),
                 F.max("size").alias("size"))
            .filter(F.col("copies") > 1)
            .withColumn("redundant_bytes", (F.col("copies") - 1) * F.col("size")))


def trim(manifest: DataFrame, taxonomy: dict | None = None) -> DataFrame:
    return manifest.filter(~noise(F.col("path"), F.col("type"), taxonomy))


def build_inventory(manifest: DataFrame, known_ids: DataFrame | None = None) -> DataFrame:
    """Source contract rows keyed by file id; unknown files get a key derived from their path.

    ``known_ids`` has columns ``path`` and ``file_id`` (an upload listing).
    """
    rel = paths.relative(F.col("path"))
    base = manifest.withColumn("rel", rel)
    if known_ids is not None:
        ids = known_ids.select(F.col("path").alias("_p"), F.col("file_id").alias("_id")).dropDuplicates(["_p"])
        base = (base.join(ids.withColumnsRenamed({"_p": "rel", "_id": "id_rel"}), "rel", "left")
                .join(ids.withColumnsRenamed({"_p": "path", "_id": "id_path"}), "path", "left")
                .withColumn("known", F.coalesce(F.nullif("id_rel", F.lit("")), F.nullif("id_path", F.lit("")))))
    else:
        base = base.withColumn("known", F.lit(None).cast("string"))
    ext = F.regexp_replace(paths.extension(F.col("rel")), r"^\.", "")
    mime = F.from_json(F.lit(json.dumps(MIME_TYPES)), "map<string,string>")
    return base.select(
        F.coalesce("known", paths.local_key(F.col("rel"))).alias("file_id"),
        paths.base_name(F.col("rel")).alias("name"),
        F.col("rel").alias("local_path"), F.col("rel").alias("drive_path"),
        F.when(F.col("known").isNotNull(), F.concat(F.lit("https://drive.google.com/file/d/"), "known", F.lit("/view")))
        .otherwise(F.concat(F.lit("local://"), "rel")).alias("source_uri"),
        F.col("unit").alias("org_unit"), F.try_element_at(mime, ext).alias("mime_type"))


# The standard media types by extension, without what a machine may add to them.
MIME_TYPES = {ext.removeprefix("."): mime for ext, mime in mimetypes.MimeTypes().types_map[True].items()}
