"""File paths: folders, extensions, stable keys, owners encoded in the folder tree."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceloom.functions.fold import slug, strip
from sourceloom.functions.lets import let, none_if_blank
from sourceloom.functions.words import file_stem

# Extension routing and the folder conventions shipped by default.
EXTRACTION_METHODS = {
    ".pdf": "pdf", ".xlsx": "sheet", ".xls": "sheet", ".xlsm": "sheet", ".csv": "sheet", ".tsv": "sheet",
    ".docx": "docx", ".doc": "office", ".pptx": "office", ".ppt": "office", ".odt": "office",
    ".odp": "office", ".ods": "office", ".rtf": "office", ".md": "text", ".txt": "text", ".json": "text",
}
CONVENTIONS = {
    "entity_anchors": ["portfolio", "clients", "projects", "accounts", "companies"],
    "prospect_anchors": ["pipeline", "dealflow", "prospects", "leads", "opportunities"],
    "status_markers": ["archived", "closed", "sold", "exit", "won", "lost", "paused", "on-hold", "churned"],
    "non_entity_names": ["reporting", "legal", "finance", "financials", "admin", "hr", "contracts",
                         "meetings", "minutes", "invoices", "accounting", "compliance", "docs", "misc"],
}
FILE_NAME = (r"(?i)\.(?:pdf|xlsx?|xlsm|docx?|pptx?|csv|tsv|txt|md|json|jpe?g|png|heic|zip|7z|rtf|odt|ods|odp)$")
NUMBERED = r"^(\d+)\s*[.\-]\s*(.+)$"

ENTITY_TYPE = "struct<name:string,slug:string,kind:string,seq:bigint,status:string,stage:string>"


def relative(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def top_folder(path: Column) -> Column:
    return F.substring_index(relative(path), "/", 1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, '' when there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def extraction_method(ext: Column) -> Column:
    routes = F.create_map(*[F.lit(x) for kv in EXTRACTION_METHODS.items() for x in kv])
    return F.coalesce(F.try_element_at(routes, F.lower(ext)), F.lit("text"))


def local_key(rel: Column) -> Column:
    return F.concat(F.lit("local-"), F.substring(F.sha1(rel), 1, 12))


def join_path(parent: Column, name: Column) -> Column:
    return F.replace(F.concat(F.regexp_replace(parent, "/+$", ""), F.lit("/"), name), F.lit("//"), F.lit("/"))


def page_slug(file_name: Column, file_id: Column) -> Column:
    """Readable and unique: slug of the name plus a short hash of the id."""
    base = F.substring(slug(file_stem(file_name)), 1, 70)
    return F.concat(F.when(base == "", F.lit("doc")).otherwise(base), F.lit("-"),
                    F.substring(F.sha1(F.coalesce(file_id, F.lit(""))), 1, 6))


def page_folder(entity_slug: Column, kind: Column, unit: Column) -> Column:
    owned, unit_slug = F.coalesce(entity_slug, F.lit("")) != "", slug(unit)
    return (F.when(owned & (kind == "prospect"), F.concat(F.lit("prospects/"), entity_slug))
            .when(owned, F.concat(F.lit("entities/"), entity_slug))
            .when(F.coalesce(unit, F.lit("")) != "",
                  F.concat(F.lit("units/"), F.when(unit_slug == "", F.lit("untitled")).otherwise(unit_slug)))
            .otherwise(F.lit("general")))


# --- entity resolution from folder names -----------------------------------------------------
def _first_word(segment: Column) -> Column:
    return F.regexp_extract(F.lower(segment), r"(\S+)", 1)


def _status_pattern(markers: list[str]) -> str:
    import re
    return r"(?i)[-–(]\s*(" + "|".join(re.escape(m) for m in markers) + r")\s*\)?\s*$"


def split_status(name: Column, markers: list[str]) -> Column:
    """struct<name,status>: a trailing "- archived" or "(closed)" taken off the name."""
    pattern = _status_pattern(markers)
    return F.struct(F.trim(F.regexp_replace(name, pattern, "")).alias("name"),
                    F.lower(none_if_blank(F.regexp_extract(name, pattern, 1))).alias("status"))


def _tracked_folder(segs: Column, conv: dict) -> Column:
    """First anchor folder whose numbered child is an entity; one year folder may lie between."""
    anchors = [a.lower() for a in conv["entity_anchors"]]
    blocked = [n.lower() for n in conv["non_entity_names"]]

    def usable(seg: Column) -> Column:
        raw = F.trim(F.regexp_extract(seg, NUMBERED, 2))
        return F.when(~raw.rlike(FILE_NAME) & ~_first_word(raw).isin(blocked), seg)

    def child(pair: Column) -> Column:
        # a numbered child that is a file or an admin folder ends the search at this anchor
        return (F.when(pair["near"].rlike(NUMBERED), usable(pair["near"]))
                .when(pair["near"].rlike(r"^20\d\d\b") & pair["far"].rlike(NUMBERED), usable(pair["far"])))

    def child_of(seg: Column, i: Column) -> Column:
        is_anchor = _first_word(seg).isin(anchors) | F.lower(seg).isin(anchors)
        return F.when(is_anchor, let(F.struct(strip(F.get(segs, i + 1)).alias("near"),
                                              strip(F.get(segs, i + 2)).alias("far")), child))

    return F.get(F.filter(F.transform(segs, child_of), lambda c: c.isNotNull()), F.lit(0))


def _prospect_position(segs: Column, conv: dict) -> Column:
    anchors = [a.lower() for a in conv["prospect_anchors"]]
    at = F.transform(segs, lambda seg, i: F.when(
        F.lower(seg).isin(anchors) & F.coalesce(~F.trim(F.get(segs, i + 2)).rlike(FILE_NAME), F.lit(False)), i))
    return F.get(F.filter(at, lambda i: i.isNotNull()), F.lit(0))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def anchored_entity(path: Column, conventions: dict | None = None) -> Column:
    """Entity named by the anchor folders (pass 1), NULL when there is none."""
    conv = conventions or CONVENTIONS

    def locate(segs: Column) -> Column:
        return let(F.struct(_tracked_folder(segs, conv).alias("tracked"),
                            _prospect_position(segs, conv).alias("pos")), lambda h: F.struct(
            F.coalesce(F.trim(F.regexp_extract(h["tracked"], NUMBERED, 2)), F.trim(F.get(segs, h["pos"] + 2))).alias("raw"),
            F.regexp_extract(h["tracked"], NUMBERED, 1).cast("bigint").alias("seq"),
            F.when(h["tracked"].isNull(), F.get(segs, h["pos"] + 1)).alias("stage")))

    def build(hit: Column) -> Column:
        return F.when(hit["raw"].isNotNull(), let(split_status(hit["raw"], conv["status_markers"]), lambda ns: F.struct(
            ns["name"].alias("name"), slug(ns["name"]).alias("slug"),
            F.when(hit["seq"].isNotNull(), "tracked").otherwise("prospect").alias("kind"),
            hit["seq"].alias("seq"), ns["status"].alias("status"), hit["stage"].alias("stage"))))

    return let(let(segments(path), locate), build)


def folder_candidates(path: Column, conventions: dict | None = None) -> Column:
    """Folder names that could match the catalog in pass 2, with their position."""
    conv = conventions or CONVENTIONS

    def candidate(seg: Column, pos: Column) -> Column:
        raw = F.coalesce(none_if_blank(F.trim(F.regexp_extract(seg, NUMBERED, 2))), F.trim(seg))
        seq = none_if_blank(F.regexp_extract(seg, NUMBERED, 1)).cast("bigint")
        return F.when(~raw.rlike(FILE_NAME), let(split_status(raw, conv["status_markers"]), lambda ns: F.struct(
            pos.alias("pos"), slug(ns["name"]).alias("slug"), ns["status"].alias("status"), seq.alias("seq"))))

    found = F.transform(F.transform(segments(path), lambda x: strip(x)), candidate)
    return F.filter(found, lambda c: F.length(c["slug"]) >= 4)


def path_year(path: Column) -> Column:
    return F.array_max(F.regexp_extract_all(
        path, F.lit(r"(?<![\p{L}\p{N}_])20[0-9]{2}(?![\p{L}\p{N}_])"), F.lit(0)))


def path_period(path: Column) -> Column:
    quarter = none_if_blank(F.regexp_extract(path, r"(?i)(?<![\p{L}\p{N}_])Q\s?([1-4])(?![\p{L}\p{N}_])", 1))
    return F.concat(path_year(path), F.lit("-Q"), quarter)
