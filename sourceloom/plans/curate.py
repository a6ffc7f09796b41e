"""File tree to inventory."""
from __future__ import annotations

from pyspark.sql import DataFrame

from sourceloom.operators import curation


def curate_tree(files: DataFrame, taxonomy: dict | None = None, known_ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """classification, matrix, full manifest, manifest and inventory of scanned files."""
    classified = curation.classify(files, taxonomy)
    full = curation.curate(classified, taxonomy)
    manifest = curation.trim(full, taxonomy)
    return {"classification": classified, "matrix": curation.taxonomy_matrix(classified),
            "manifest_full": full, "manifest": manifest, "inventory": curation.build_inventory(manifest, known_ids)}
