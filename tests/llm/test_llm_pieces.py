"""What one pass of the sampler holds."""

import pyarrow as pa

from attestry.llm import pieces


def test_a_pass_holds_half_a_megabyte_and_passes_change_nothing():
    vocabulary = pieces.load_vocabulary()
    texts = [f"number {i} of the texts, " * (4000 if i < 8 else i % 3) for i in range(20)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(20), pa.int64()), "text": pa.array(texts)})
    told = list(pieces.encoded(vocabulary, batch, 2, 42, True))
    assert max(sum(len(texts[i]) for i in set(part.column("doc_id").to_pylist())) for part in told) <= 1 << 19
    alone = [row for i in range(20) for part in pieces.encoded(vocabulary, batch.slice(i, 1), 2, 42, True) for row in part.to_pylist()]
    together = [row for part in told for row in part.to_pylist()]
    assert [(r["doc_id"], r["sample"], r["pieces"], r["round_trip"]) for r in together] == [(r["doc_id"], r["sample"], r["pieces"], True) for r in alone]
