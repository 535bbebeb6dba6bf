from __future__ import annotations

import pytest

from tallyloom.llm.common import Scratch


@pytest.fixture
def scratch(spark):
    return Scratch(spark)


@pytest.fixture
def documents(spark):
    """Build documents (doc_id, text), with columns beside them that clash with internal names."""

    def build(rows):
        extra = [(*row, "x", 1, None, "y") for row in rows]
        columns = "doc_id bigint, text string, row string, size int, name string, class string"
        return spark.createDataFrame(extra, columns)

    return build
