"""Audience labels: NULL is open, an empty list is nobody."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def visible(acl: Column, audiences: Iterable[str] | None) -> Column:
    """May a client holding ``audiences`` see the row?  ``None`` is an unrestricted client."""
    if audiences is None:
        return F.lit(True)
    labels = sorted(set(audiences))
    if not labels:
        return acl.isNull()
    return acl.isNull() | F.arrays_overlap(acl, F.array(*[F.lit(a) for a in labels]))


def visible_csv(acl: Column, audiences: Iterable[str] | None) -> Column:
    """The same rule over the comma-separated encoding used by exported facts."""
    return visible(decode_csv(acl), audiences)


def decode_csv(acl: Column) -> Column:
    return F.filter(F.split(acl, ","), lambda a: a != "")


def label_ok(label: Column) -> Column:
    """Representable and grantable: no comma, not blank, not padded."""
    return label.isNotNull() & ~label.contains(",") & (F.trim(label) != "") & (F.trim(label) == label)


def declared_acl(has_key: Column, labels: Column, unreadable: Column) -> Column:
    """What a page's frontmatter grants; anything unreadable reaches nobody."""
    nobody = F.array().cast("array<string>")
    readable = labels.isNotNull() & F.forall(labels, label_ok)
    return F.when(readable, labels).when(has_key | unreadable, nobody)
