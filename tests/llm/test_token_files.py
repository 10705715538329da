import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import cases
from tradewind.llm import packing, shared, token_files
from tradewind.llm.tokenizing import Encoder, default_vocabulary


@cache
def whole():
    return Encoder(default_vocabulary()).tokenizer


def ids_of(text):
    return whole().encode(text or "", add_special_tokens=False).ids


ODD = ["", None, "\n", " ", "a  b", "a\n b c \n", "x\n\ny z", "it's a\tb c's 's", "  lead", "trail ", "a b　c  d", "don't 12ab!! ab12. <|endoftext|> x", "é ü. n\n\n\n", "word\nword. 3.5 a.b", "\nx", "x\n", "a\x1cb \x85 c", "ﬁ 中文, ok."]


def test_cutting_gives_the_ids_of_whole_texts():
    texts = [*ODD, *(t for _, t in cases.texts())]
    encoder, got = Encoder(default_vocabulary()), []
    for _, ids, sizes in encoder.encode(pa.array(texts)):
        got += np.split(ids, np.cumsum(sizes)[:-1])
    assert [g.tolist() for g in got] == [ids_of(t) for t in texts]


def test_files_give_every_document_in_order(spark):
    rows = [*cases.texts(), *((100 + i, t) for i, t in enumerate(ODD))]
    manifest = token_files.write(spark, cases.documents(spark, rows, extra=True), shared.shared_folder(spark, "t"), default_vocabulary())
    got = token_files.digest(token_files.read(manifest)).collect()
    start, expected = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*ids_of(text), 2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == expected


def test_one_document_is_read_alone_and_damage_is_seen(spark, tmp_path):
    manifest = token_files.write(spark, cases.documents(spark, [(1, "one"), (2, "two words"), (9, "nine")]).coalesce(1), str(tmp_path / "f"), default_vocabulary())
    path = manifest.first()["path"]
    reader = token_files.FileReader(path)
    assert np.frombuffer(reader.find(2)[0], "<u4").tolist() == [*ids_of("two words"), 2]
    assert reader.find(3) == []
    raw = bytearray(open(path, "rb").read())
    raw[-token_files.FOOTER.size - 1] ^= 1  # a checksum in the seek table
    (tmp_path / "bad.zst").write_bytes(raw)
    with pytest.raises(ValueError, match="checksum"):
        list(token_files.FileReader(str(tmp_path / "bad.zst")).all())


def test_no_documents(spark):
    empty = cases.documents(spark, [])
    manifest = token_files.write(spark, empty, shared.shared_folder(spark, "t"), default_vocabulary())
    assert token_files.read(manifest).collect() == []
    assert packing.pack(spark, empty, shared.shared_folder(spark, "p"), default_vocabulary()).collect() == []


# ---- packing ----------------------------------------------------------------------------------------------------


def fewest(items: list[int], capacity: int) -> int:
    """Bins by exhaustive search."""
    best = len(items)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= capacity and bins[i] not in bins[:i]:
                bins[i] += items[k]
                place(k + 1, bins)
                bins[i] -= items[k]
        bins.append(items[k])
        place(k + 1, bins)
        bins.pop()

    place(0, [])
    return best


def test_search_is_near_the_optimum_and_uses_every_piece():
    import random

    rng, extra = random.Random(2), 0
    for _ in range(60):
        items = sorted((rng.randrange(1, 40) for _ in range(rng.randrange(1, 11))), reverse=True)
        counts = {n: items.count(n) for n in items}
        found = packing.complete(counts, 40)
        used = [n for times, bin_ in found for n, use in bin_ for _ in range(times * use)]
        assert sorted(used) == sorted(items)
        assert all(sum(n * use for n, use in bin_) <= 40 for _, bin_ in found)
        bins = sum(times for times, _ in found)
        assert packing.lower_bound(counts, 40) <= fewest(items, 40) <= bins
        extra += bins - fewest(items, 40)
    assert extra <= 1


def test_pieces_and_places(spark):
    rows = cases.texts()
    got = packing.pack(spark, cases.documents(spark, rows, extra=True), shared.shared_folder(spark, "p"), default_vocabulary(), capacity=64).collect()
    expected = []
    for doc_id, text in rows:
        ids = [*ids_of(text), 2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)] if len(ids) > 64 else [0, len(ids)]
        expected += [(doc_id, k, a, b - a, np.array(ids[a:b], "<u4").tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in got), key=key) == sorted(expected, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.02 * sum(r["length"] for r in got) / 64 + 1
