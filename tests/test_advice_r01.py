
import datetime

from ordinanza.operators import chunks
from ordinanza.plans import core


def test_fallback_of_sources_without_valid_sections(spark, tmp_path):
    body = "a rule that is long enough to count as a valid section of this file"
    files = {
        "none": [f"line {i} of a file that has no section number at all" for i in range(120)],
        "nine": [x for i in range(9) for x in (f"1.1.{i} Title", body)] + [f"2.2.{i} short" for i in range(6)],
        "ten": [x for i in range(10) for x in (f"1.1.{i} Title", body)],
    }
    t = datetime.datetime(2024, 1, 1)
    rows = [(s, 1 + i // 30, i % 30, x, t, t) for s, ls in files.items() for i, x in enumerate(ls)] + [(None, 1, 0, "x", t, t), ("none", 1, 90, None, t, t)]
    spark.createDataFrame(rows, "source string, page int, elem_no int, text string, scanned_at timestamp, loaded_at timestamp").write.parquet(str(tmp_path / "ocr_elements.parquet"))
    got = core.fallback_chunks(spark, str(tmp_path)).orderBy("source", "chunk_no").collect()
    assert {r.source for r in got} == {"none", "nine"}
    for s in ("none", "nine"):
        assert [r.chunk for r in got if r.source == s] == chunks.chunk_text("\n".join(files[s]), 1000, 200)
    none = [r for r in got if r.source == "none"]
    assert [r.label for r in none] == [f"chunk_{i:04d}" for i in range(len(none))]
    assert [r.page for r in none] == [1 + files["none"].index(r.chunk.split("\n")[0]) // 30 for r in none]
    assert [r.label for r in got if r.source == "nine"][0] == "1.1.0"
    assert chunks.expand_pages(spark.createDataFrame([("a", 1, None), (None, 1, "x"), ("b", 1, "")], "s string, page int, t string"), "s", "page", "t").count() == 0
