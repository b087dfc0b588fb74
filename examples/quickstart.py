"""Anonymize the sample staff table end to end.

    python examples/quickstart.py [path/to/staff.csv]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from veil import Metadata, Release, read_csv  # noqa: E402
from veil.session import local_session, scratch_path  # noqa: E402


def main(path: str) -> None:
    spark = local_session(master="local[4]")
    md = Metadata(
        column_types={"badge": "numeric", "years": "numeric", "office": "numeric", "team": "categorical"},
        identifiers=["badge"], quasi_identifiers=["years", "office"], sensitive_attributes=["team"],
    )
    release = Release(read_csv(spark, path, md), md)
    release = (
        release.order_preserving_pseudonyms("badge")
        .generalize("years", bins=10)
        .perturb("office", noise_std=0.05, random_state=7)
        .mask("team", "mask_last_k", k=3)
    )
    release.preview(10, order_by=["badge"]).show()
    release.precision_privacy(digits=1).show()
    release.statistics(digits=4).show()
    bundle = scratch_path(spark, "quickstart")
    release.save(bundle)
    restored = Release.load(spark, bundle).reverse_pseudonyms("badge")
    restored.preview(5, order_by=["badge"]).show()
    restored.export_csv(scratch_path(spark, "quickstart-csv"))


if __name__ == "__main__":
    default = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tests", "data", "staff.csv")
    main(sys.argv[1] if len(sys.argv) > 1 else default)
