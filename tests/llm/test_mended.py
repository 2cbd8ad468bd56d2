"""Names that clash with internal ones, licence names inside others, and the bounds of the pre-token cache."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from foliospark.llm import bpe, language, licenses, line_dedup, pii, token_counts

SCHEMA = "doc_id bigint, text string, lang string"
NAMES = ("_id", "_hash", "_base", "_terms", "_lost_id", "_lost", "_kept", "_judged", "_j", "_KEPT_")


def test_internal_names_may_be_taken(spark):
    line = "this very line is long enough to be counted"
    docs = spark.createDataFrame([(i, f"{line}\nown words {i} bob@x.org", "en") for i in range(6)], SCHEMA).withColumns({c: F.lit(c) for c in NAMES})
    for out in (line_dedup.drop_lines(docs), pii.sanitise(docs), language.identify(docs)):
        rows = out.collect()
        assert len(rows) == 6 and all(r[c] == c for r in rows for c in NAMES)
    kept = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_lines(docs).collect()}
    assert kept == {i: int(i < 5) for i in range(6)}


@pytest.mark.parametrize("text, labels", [
    ("under the GNU Lesser General Public License version 3", "gpl,lgpl-3.0"), ("GNU Affero General Public License, version 3", "agpl-3.0,gpl"),
    ("GNU Lesser General Public License version 2.1", "gpl,lgpl-2.1"), ("GNU General Public License version 2", "gpl,gpl-2.0"),
    ("CC BY 4.0 ND", "cc-by"), ("CC BY 4.0", "cc-by,cc-by-4.0"), ("CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa-4.0"),
    ("it is not licensed under the MIT License", ""), ("licensed under the MIT License", "mit-notice"),
    ("Neither the name of the Example Project nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "bsd-3-clause"),
    ("You may not use this file except in compliance with the License. You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0 "
     "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or "
     "conditions of any kind, either express or implied.", "apache-2.0-terms")])
def test_licence_labels(text, labels):
    _, base, found = licenses.scan_text(text, tuple(licenses.TEMPLATES.items()), tuple(licenses.BASE.items()))
    assert ",".join(sorted({x[0] for x in (*base, *found)})) == labels


def test_whole_licences_match_their_own_template():
    for label, markup in licenses.TEMPLATES.items():
        if "<<" not in markup:
            assert label in {x[0] for x in licenses.scan_text(markup, tuple(licenses.TEMPLATES.items()), ())[2]}


def test_the_cache_is_bounded_in_characters(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHARS", 10_000)
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_counts._CACHES.pop(path, None)
    whole = [int(token_counts.counts([chr(97 + i % 26) * 4_000 + "z" * (i // 26)], path)[0]) for i in range(30)]
    held = token_counts._CACHES[path]
    assert sum(map(len, held)) == held.chars <= 10_000 + 4_100 and len(held) < 5
    token_counts._CACHES.pop(path)
    monkeypatch.setattr(bpe, "CACHE_CHARS", 8_000_000)
    assert whole == [int(token_counts.counts([chr(97 + i % 26) * 4_000 + "z" * (i // 26)], path)[0]) for i in range(30)]
