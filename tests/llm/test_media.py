import hashlib
import zlib

import numpy as np
import pytest
from folioframe.llm import jpeg, media


def payload_cases():
    rng = np.random.default_rng(1)
    return [bytes(64), b"a" * 64, bytes([1]) * 64 * 7, bytes([1] * 20 + [0] * 17 + [1] + [2] * 26) * 9, bytes([255]) * 6400,
            rng.integers(0, 256, 64 * 100, dtype=np.uint8).tobytes(), rng.integers(0, 3, 64 * 200, dtype=np.uint8).tobytes(),
            (rng.random(64 * 300) < 0.03).astype(np.uint8).tobytes(), (rng.integers(0, 256, 64 * 97) * (rng.random(64 * 97) < 0.1)).astype(np.uint8).tobytes()]


def read(files):
    images = [jpeg.Image(f) for f in files]
    coefs, first = jpeg.coefficients(images)
    return images, coefs, first


def test_round_trip_alone_and_together():
    cases = payload_cases()
    files = jpeg.encode(cases)
    images, coefs, first = read(files)
    assert jpeg.payloads(images, coefs, first) == cases
    together = jpeg.tensors(images, coefs, first)
    for i, c in enumerate(cases):
        assert jpeg.encode([c]) == [files[i]]
        assert (jpeg.tensors(*read([files[i]]))[0] == together[i]).all()


def test_scans_are_progressive():
    image = jpeg.Image(jpeg.encode([bytes(range(64)) * 12])[0])
    bands = [(s[1], s[2], s[3]) for s in image.scans]
    assert ((1, 5), 0, 1) in bands and ((6, 63), 0, 1) in bands         # spectral selection
    assert ((0, 0), 1, 0) in bands and ((1, 63), 1, 0) in bands         # successive approximation
    assert image.scale == [(1, 1), (2, 2), (2, 2)]


def test_inverse_transform_against_definition():
    rng = np.random.default_rng(2)
    c = rng.integers(-40, 40, (20, 64))
    got = jpeg.inverse_transform(c)
    basis = np.array([[(np.sqrt(1 / 8) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    natural = np.zeros((20, 64))
    natural[:, jpeg.ZIGZAG] = c
    want = np.einsum("ux,nuv,vy->nxy", basis, natural.reshape(20, 8, 8), basis) + 128
    assert np.abs(got - np.clip(np.rint(want), 0, 255)).max() <= 1


def test_another_decoder_reads_the_files(spark):
    """The Java runtime's own reader gives about the same picture."""
    jvm = spark._jvm
    try:
        reader = jvm.javax.imageio.ImageIO
        rng = np.random.default_rng(5)
        soft = np.zeros((6 * 4, 64), dtype=np.uint8)
        soft[:, 0] = rng.integers(0, 200, len(soft))
        soft[:, 1:6] = rng.integers(0, 30, (len(soft), 5))
        raw = jpeg.encode([soft.tobytes()])[0]
        picture = reader.read(jvm.java.io.ByteArrayInputStream(bytearray(raw)))
    except Exception:       # noqa: BLE001 - no desktop module in this runtime
        pytest.skip("no image reader in the Java runtime")
    tensor = jpeg.tensors(*read([raw]))[0]
    assert (picture.getHeight(), picture.getWidth()) == tensor.shape[:2]
    for y, x in ((0, 0), (5, 9), (17, 3), (31, 31)):
        rgb = picture.getRGB(x, y) & 0xFFFFFF
        assert abs((rgb >> 16) - int(tensor[y, x, 0])) + abs((rgb >> 8 & 255) - int(tensor[y, x, 1])) + abs((rgb & 255) - int(tensor[y, x, 2])) < 60


def test_grey_file_with_odd_size_and_quantisers():
    """A file that the coder does not write: one component, 10 x 13, no restart intervals, quantisers above one."""
    dc, ac = jpeg.DC_CODES, jpeg.AC_CODES
    level = [3, -2, 5, 7]               # differences of the four blocks
    value = np.array([(int(dc.code[abs(v).bit_length()]) << abs(v).bit_length()) | (v if v > 0 else v + (1 << abs(v).bit_length()) - 1) for v in level], dtype=np.uint64)
    size = np.array([int(dc.size[abs(v).bit_length()]) + abs(v).bit_length() for v in level])
    raw, n = jpeg.pack_bits(value, size, np.zeros(4, dtype=np.int64), 1)
    data, _ = jpeg.stuff(raw, n, np.zeros(1, dtype=np.int64))
    file = b"".join([b"\xff\xd8\xff\xdb\x00\x43\x00", bytes([16] * 64), b"\xff\xc2\x00\x0b\x08\x00\x0d\x00\x0a\x01\x01\x11\x00", dc.segment(0), ac.segment(1),
                     jpeg._scan_header([0], (0, 0), (0, 0)), data.tobytes(), b"\xff\xd9"])
    tensor = jpeg.tensors(*read([file]))[0]
    assert tensor.shape == (13, 10, 3)
    assert [int(tensor[y, x, 0]) for y, x in ((0, 0), (0, 8), (8, 0), (8, 8))] == [128 + 2 * v for v in np.cumsum(level)]


def test_query_on_whole_table(spark, sf_dir):
    from folioframe.llm.queries import QUERIES
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op7_media"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    by_text = {}
    for r in rows:
        n, p = media.payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert by_text.setdefault(texts[r.doc_id], (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_odd_rows(odd_docs):
    rows = media.decode(media.encode(odd_docs, ["doc_id", "n_bytes"] if "n_bytes" in odd_docs.columns else ["doc_id"]), ["doc_id", "n_bytes"]).collect()
    assert len(rows) == odd_docs.count()
    assert all(bytes(r.payload) == bytes(64) and r.n_bytes == 0 for r in rows if r.doc_id in (1, 2))
    assert all(len(r.tensor) == 3 * r.width * r.height for r in rows)
    assert media.digests(odd_docs.where("false")).count() == 0
