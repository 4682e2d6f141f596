"""How the spatial queries use their operators."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from cellmosaic.operators import spatial

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["join_count_by_assay", "smoothed_by_assay"])
def test_modalities_share_one_neighbour_graph(spark, monkeypatch, name):
    found, searched = spatial.nearest_neighbours, []

    def spy(spots, n, by=("rep_id",)):
        searched.append(tuple(by))
        return found(spots, n, by)

    monkeypatch.setattr(spatial, "nearest_neighbours", spy)
    contract.queries()[name](spark, FOLDER)
    assert searched == [("rep_id",)]
