"""Content-defined chunks (Q20, F8) and the archive made of them."""

import random
import zlib

from tagflow import sources


def test_chunks_join_up_and_stay_short():
    rng = random.Random(1)
    for data in (b"", b"a", b"x" * 200_000, rng.randbytes(200_000)):
        ends = sources.chunk_ends(data)
        sizes = [y - x for x, y in zip([0, *ends], ends)]  # noqa: B905
        assert sum(sizes) == len(data) and all(0 < s <= 60 << 10 for s in sizes)


def test_a_passage_moved_within_a_long_line_is_found(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    passage = text(60_000)
    blocks = [(0, text(5000) + passage + text(3000)), (1, text(777) + passage), (2, None), (3, "")]
    chunks = sources.content_chunks(spark.createDataFrame(blocks, "block long, data string"))
    out = sources.deflated(sources.archive(chunks, ["block", "item"])).orderBy("block", "item").collect()
    again = [r for r in out if not r["is_first"]]
    assert len(again) > 3 and all(r["block"] == 1 and r["payload"] is None for r in again)
    held = {r["fingerprint"]: zlib.decompress(bytes(r["payload"])) for r in out if r["is_first"]}
    for b in (0, 1):
        assert b"".join(held[r["fingerprint"]] for r in out if r["block"] == b).decode() == blocks[b][1]
