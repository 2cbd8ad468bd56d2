"""The stream over the document table, as one file and as a folder of part files."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from foliospark.plans.queries_training import stream_process

SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


@pytest.mark.parametrize("files", [0, 2])
def test_every_document_of_the_table_has_an_outcome(spark, tmp_path, files):
    rows = [{"doc_id": i, "text": " ".join(f"word{(i * j) % 9} other{j % (i + 2)}" for j in range(30)) if i % 5 else "short", "lang": "en", "source": "s", "n_chars": 1} for i in range(12)]
    target = tmp_path / "documents.parquet"
    if files:
        target.mkdir()
    for i in range(max(files, 1)):
        pq.write_table(pa.Table.from_pylist(rows[i::max(files, 1)], SCHEMA), target / f"part-{i}.parquet" if files else target)
    got = stream_process(spark, str(tmp_path)).collect()
    assert sum(r["n"] for r in got) == len(rows)
