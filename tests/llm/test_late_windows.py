from collections import Counter

import pyarrow as pa

from tidemill.llm import substring_dedup


def test_late_windows_of_a_map_step_spread_over_buckets():
    text = " ".join(f"w{i}" for i in range(60))
    batch = pa.RecordBatch.from_arrays([pa.array(range(0, 400_000, 1000)), pa.array([text] * 400)], ["doc_id", "text"])
    late = Counter()
    for out in substring_dedup._windows(20, 256, 256)(iter([batch])):
        for row in out.to_pylist():
            if row["known"]:
                late[row["bucket"]] += len(substring_dedup.unsqueeze(row["ids"], "i8"))
    assert sum(late.values()) == 399 * 41 and max(late.values()) < sum(late.values()) / 10
