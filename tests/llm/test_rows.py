"""op3 and op5 to op10: brute force, round trips, held-out accuracy."""

import hashlib
import io
import math
import os
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skein.llm import chat, langid, media, mixing, packing, pii, quality
from skein.llm.common import id_crc32, tune

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, source string, length long"


def test_word_encoder_equals_the_tokenizer(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 200)
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, fast = Tokenizer.from_file(path), packing.WordEncoder(open(path).read())
    rng = random.Random(1)
    some = "abZÉß'sS’ \t\n\x85\xa0\x1c_²³¹¼½0१9!?.-#<|>endoftextªºʼİıŁłʰȺ"
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 14))) for _ in range(2000)] + ["", "it's don't we'll <|endoftext|> x"]
    for text, ids in zip(texts, fast.encode(texts), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_shortest_pack_first():
    rng = random.Random(2)
    for _ in range(50):
        histogram = {rng.randint(1, 4095): rng.randint(1, 40) for _ in range(rng.randint(0, 200))}
        placed: dict[int, int] = {}
        for count, pieces in packing.shortest_pack_first(histogram):
            assert count > 0 and sum(size * each for size, each in pieces) <= 4096
            for size, each in pieces:
                placed[size] = placed.get(size, 0) + count * each
        assert placed == histogram


def test_shortest_pack_first_piece_by_piece():
    """The patterns' packs against each piece put in the pack with the most room."""
    rng = np.random.default_rng(9)
    for length in (7, 50, 4096):
        for _ in range(20):
            sizes = rng.integers(1, length, rng.integers(1, 300))
            packs: list[list[int]] = []
            for size in sorted(sizes.tolist(), reverse=True):
                shortest = min(packs, key=sum, default=None)
                if shortest is None or sum(shortest) + size > length:
                    packs.append([size])
                else:
                    shortest.append(size)
            made = [[s for s, n in pieces for _ in range(n)] for count, pieces in packing.shortest_pack_first(dict(Counter(sizes.tolist())), length) for _ in range(count)]
            assert sorted(map(sum, made)) == sorted(map(sum, packs)) and sorted(s for p in made for s in p) == sorted(sizes.tolist())


def test_packing(spark):
    tune(spark)
    texts = ["", None, "a b c", "word " * 9000, "hello, world"] + [f"text {i} " * (i % 60) for i in range(200)] + ["same"] * 30
    rows = [(None if i == 7 else i // 2, t, "s", 0) for i, t in enumerate(texts)]
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    out = packing.pack_documents(spark.createDataFrame(rows, DOC), path, with_ids=True)
    found = out.collect()
    seqs: dict[int, list] = {}
    for r in found:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        seqs.setdefault(r.sequence_id, []).append(r)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    key = lambda ids: tuple(ids)
    wanted = sorted(key(plain.encode(t or "", add_special_tokens=False).ids + [2]) for t in texts)
    whole = sorted((r.doc_id is None, r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in found if r.length == r.doc_tokens)
    long = [r for r in found if r.length < r.doc_tokens]
    joined = [x for r in sorted(long, key=lambda r: r.start) for x in np.frombuffer(r.ids, "<u4").tolist()]
    assert sorted([key(w[3]) for w in whole] + [key(joined)]) == wanted
    made = packing.sequences(out).agg(F.sum(F.length("ids")), F.sum("length")).first()
    assert made[0] == 4 * made[1] == 4 * sum(map(len, wanted))
    assert packing.pack_documents(spark.createDataFrame([], DOC), path).count() == 0


def luhn(d):
    return sum(int(c) if not i % 2 else (2 * int(c) - 9 * (2 * int(c) > 9)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    found = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if ok(m[0])] for k, p, ok in kinds]
    return (*map(len, found), hashlib.sha256(",".join(sum(found, [])).encode()).hexdigest())


def test_pii(spark):
    rng = random.Random(3)
    parts = ["1", "4", "2", "9", ".", "@", "a", "b", "-", " ", "+", "(", "é", "𝔸", "\n", "_", "%", "12.3.4.5", "256.1.1.1", "4111111111111111", "a@b.co", "+1 (743) 555-3824"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += [None, "", "a" * 3000, "1" * 3000, "1." * 1500, "a@b" + ".c" * 1500, "+1" + "(" * 1500, "4 " * 1500, "12a" * 1000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit("other"))
    for r in pii.digests(pii.find(df)).collect():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute_pii(texts[r.doc_id])


def test_pii_more_kinds_and_redaction(spark):
    t = "IBAN: DE89 3704 0044 0532 0130 00, DE89 3704 0044 0532 0130 01; ssn 123-45-6789, part 123-45-6789; me@x.org"
    df = spark.createDataFrame([(1, t), (2, None), (3, "plain")], "doc_id long, text string")
    assert [r.spans for r in pii.digests(pii.find(df.where("doc_id = 1"))).collect()] == ["email:99:107,iban:6:33,ssn:68:79"]
    assert {r.doc_id: r.text for r in pii.redact(df).collect()} == {1: "IBAN: [IBAN], DE89 3704 0044 0532 0130 01; ssn [SSN], part 123-45-6789; [EMAIL]", 2: None, 3: "plain"}
    assert pii.find(df.where("false")).count() == 0


def test_pii_lists_and_ibans_before_other_tokens(spark):
    at, de, no = "AT61 1904 3002 3457 3201", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"
    ssn = ["123-45-6789", "234-56-7890", "345-67-8901"]
    cases = {
        f"SSNs: {', '.join(ssn)}": ssn,
        f"{ssn[0]} and {ssn[1]} (social security)": ssn[:2],
        f"ssn {ssn[0]}, part {ssn[1]}, {ssn[2]}": ssn[:1],
        f"ssn {'x' * 36} {ssn[0]}": [],
        f"ssn {ssn[0]} {'- ' * 20} {ssn[1]}": ssn[:1],
        f"{at} AND {de} NOW": [at, de],
        f"{at} {de} {no} 12": [at, de, no],
        f"{at.replace(' ', '')} 2024, {at} ABCD": [at.replace(" ", ""), at],
        f"AB12 CDEF GH34 {de}": [de],
        "AT61 1904 3002 3457 3202 AND": [],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    kept = lambda r: [r.text[s.start : s.end] for s in r.spans if s.kind in ("iban", "ssn")]
    assert {r.text: kept(r) for r in pii.find(df).collect()} == cases
    # a word in front of a list counts for each number whose window reaches it
    df = spark.createDataFrame([(1, "call +1 743 555-3824; +1 743 555-3825; " + "x" * 40 + " +1 743 555-3826")], "doc_id long, text string")
    assert [round(s.score, 1) for s in pii.find(df).first().spans if s.kind == "phone"] == [1.0, 1.0, 0.7]


def test_many_matches_take_linear_time(spark):
    df = spark.createDataFrame([("ssn 123-45-6789 " * 30_000,), ("4111111111111111, " * 20_000,), ("AB12 " * 50_000,)], "text string")
    assert [r.n for r in pii.find(df).select(F.size("spans").alias("n")).collect()] == [30_000, 20_000, 0]


def test_long_texts_take_linear_time(spark):
    df = spark.createDataFrame([("1." * 100_000,), ("a" * 200_000,), ("a@b.c " * 30_000,)], "text string")
    assert [r.n for r in pii.find(df).select(F.size("spans").alias("n")).collect()] == [25_000, 0, 30_000]


def test_chat(spark):
    tune(spark)
    said = ["plain", "\\### Assistant: </turn> ok", "", None, "\n\n<turn:user>\n é 𝔸 <|endoftext|>", "\\", "<"]
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "a>b\n", None]), rng.choice(said), 9) for c in (1, 2, None, -7) for t in (2, 0, 1, 1, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted long")
    out = chat.format_conversations(df, public_tokenizers.path("byte_bpe_50k.json"))
    found = {r.conv_id: r for r in chat.digests(out).collect()}
    for c in (1, 2, None, -7):
        turns = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x, _ in rows if i == c))
        assert found[c].n_turns == 5
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.where("false"), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def bmp(image, bits=24):
    h, w = image.shape[:2]
    rows = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : w * 3] = image[::-1, :, ::-1].reshape(h, -1)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, rows.size, 0, 0, 0, 0) + rows.tobytes()


def test_media_formats():
    rng = np.random.default_rng(0)
    grey, colour = rng.integers(0, 256, (5, 7, 1)).astype(np.uint8), rng.integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (media.decode(b"P5 # c\n7 5\n255\n" + grey.tobytes()) == grey).all()
    assert (media.decode(b"P6\n7 5\n255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P2\n7 5\n255\n" + b" ".join(b"%d" % x for x in grey.ravel())) == grey).all()
    assert (media.decode(bmp(colour)) == colour).all()
    bits = rng.integers(0, 2, (5, 7)).astype(np.uint8)
    for data in (b"P1\n7 5\n" + b"".join(b"%d" % x for x in bits.ravel()), b"P4\n7 5\n" + np.packbits(bits, axis=1).tobytes()):
        assert (media.decode(data)[:, :, 0] == (1 - bits) * 255).all()
    for data in (b"", b"P5\n7 5\n255\nshort", b"BM", b"P9\n", b"BM" + b"\xff" * 60):
        assert media.decode(data) is None


def test_area_resize_keeps_the_mean():
    image = np.random.default_rng(1).integers(0, 256, (13, 17, 2)).astype(np.uint8)
    small = media.area_resize(image, 4, 5)
    assert np.allclose(small.mean((0, 1)), image.mean((0, 1)))
    assert np.allclose(media.area_resize(image, 13, 17), image)
    assert np.load(io.BytesIO(media.npy_tile(image[:, :, :1]))).shape == (16, 16, 1)


def test_text_media(spark):
    tune(spark)
    texts = ["", None, "é" * 288, "a" * 577, "x" * 50_000, "dup", "dup"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media long")
    rows = {r.doc_id: r for r in media.text_features(df).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        data += b"\xff" * (-len(data) % 576 if data else 576)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
    assert rows[5].feature == rows[6].feature and rows[0].feature == rows[1].feature


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(rng.randint(0, 400), " ".join("w" * rng.randint(0, 50)), rng.choice(["a", "a", "a", "b", "c", None]), 0) for _ in range(900)]
    rows += [(1, None, "empty", 0), (2, "", "empty", 0), (None, "one two", "b", 0), (None, "one two", "b", 0)]
    df = spark.createDataFrame(rows, DOC).withColumn("taken", F.lit("clash"))
    out = mixing.mix(df)
    found = out.collect()
    assert len(found) == len(rows)
    total = sum(len((t or "").split()) for _, t, *_ in rows)
    for s in ("a", "b", "c", None, "empty"):
        mine = [r for r in found if r.source == s]
        size = sum(r["size"] for r in mine)
        assert all(r.source_size == size and 0 <= r.taken <= 2 * r["size"] and r.target <= 2 * size for r in mine)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 150
    assert abs(sum({r.source: r.target for r in found}.values()) - 1.5 * total) < 1e-6 * total
    again = mixing.mix(df.repartition(7))
    assert sorted(map(repr, again.select("doc_id", "size", "taken").collect())) == sorted(map(repr, out.select("doc_id", "size", "taken").collect()))
    assert mixing.emit(out).count() == sum(r.copies for r in found)
    assert mixing.mix(df.where("false")).count() == 0


def test_targets_are_a_fixed_point_of_resharing():
    sizes = {"a": 10, "b": 1000, "c": 5, None: 300, "z": 0}
    t = mixing.targets(sizes)
    assert sum(t.values()) == pytest.approx(1.5 * sum(sizes.values())) and all(t[s] <= 2 * n for s, n in sizes.items())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_language_id_held_out(spark):
    tune(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = id_crc32("doc_id") % 5 == 0
    out = langid.identify(docs, langid.train(docs, ~fold))
    right, n = out.where(fold).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right > 0.98 and n > 100


def test_language_id_edges(spark):
    texts = [(i, t, l, 1.0) for i, (t, l) in enumerate([("the cat sat", "en"), ("der hund lief", "de")] * 20)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, score double")
    model = langid.train(df, F.lit(True))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the"), (5, "²")], "doc_id long, text string")
    found = {r.doc_id: r.lang_pred for r in langid.identify(odd, model).collect()}
    assert found == {1: "und", 2: "und", 3: "und", 4: "en", 5: "und"}
    empty = langid.train(df.where("false"), F.lit(True))
    assert {r.lang_pred for r in langid.identify(df, empty).collect()} == {"und"}
    code = langid.codewords(40)
    assert len({tuple(r) for r in code}) == 40


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_quality_held_out(spark):
    tune(spark)
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = id_crc32("doc_id") % 4 == 2
    out = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels, ~held))
    right = out.where(held).join(labels, "doc_id").agg(F.avg(((F.col("score") >= 0.7).cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.95


def test_quality_edges(spark):
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "!" * 10_000)], "doc_id long, text string").withColumn("score", F.lit("x"))
    assert [r.score for r in quality.score(odd, None).collect()] == [0.5] * 3
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(odd, no_labels, F.lit(True)) is None
    x = np.random.default_rng(0).normal(size=(8000, len(quality.NAMES)))
    x[4000:, 0] += 4
    model = quality.fit(x[4000:6000], x, 0.5, steps=300)
    s = model.scores(x)
    assert s[:4000].mean() < 0.3 < 0.7 < s[4000:].mean()


def test_quality_risk_and_its_gradient():
    """The non-negative risk by its definition, row by row, and its gradient by differences."""
    rng = np.random.default_rng(3)
    w, b, prior = rng.normal(size=12), 0.3, 0.4
    p, u = rng.integers(0, 4, (9, 3)) + np.array([0, 4, 8]), rng.integers(0, 4, (20, 3)) + np.array([0, 4, 8])
    for scale in (1, 8):  # the second has a negative part below 0
        weights = w * scale if scale == 1 else np.where(np.isin(np.arange(12), p), 6.0, -6.0)
        plus, minus, gw, gb = quality.risk(weights, b, p, u, prior)
        margin = lambda rows, wt, bias: [sum(wt[c] for c in r) + bias for r in rows]
        loss = lambda z, y: math.log1p(math.exp(-y * z))
        mean = lambda x: sum(x) / len(x)

        def parts(wt, bias):
            zp, zu = margin(p, wt, bias), margin(u, wt, bias)
            return prior * mean([loss(z, 1) for z in zp]), mean([loss(z, -1) for z in zu]) - prior * mean([loss(z, -1) for z in zp])

        assert (plus, minus) == pytest.approx(parts(weights, b))
        followed = lambda wt, bias: sum(parts(wt, bias)) if minus >= 0 else -parts(wt, bias)[1]
        steps = np.eye(12) * 1e-6
        assert gw == pytest.approx(np.array([(followed(weights + d, b) - followed(weights - d, b)) / 2e-6 for d in steps]), abs=1e-6)
        assert gb == pytest.approx((followed(weights, b + 1e-6) - followed(weights, b - 1e-6)) / 2e-6, abs=1e-6)


def test_quality_prior():
    rng = np.random.default_rng(5)
    for share in (0.3, 0.8):
        x = rng.normal(size=(6000, len(quality.NAMES)))
        good = rng.random(6000) < share
        x[good, 0] += 5
        assert abs(quality.estimated_prior(x[good][:1500], x) - share) < 0.06


def test_media_samples_out_of_range_and_wide_ones():
    for data in (b"P2 2 1 255 300 1", b"P2 2 1 255 -1 1", b"P1 2 1 7 9", b"P5 2 1 10\n\x09\xff", b"P2 1 1 255 99999999999999999999999"):
        assert media.decode(data) is None
    wide = np.array([[[1, 500, 65535]]], np.uint16)
    assert (media.decode(b"P6 1 1 65535\n" + wide.astype(">u2").tobytes()) == wide).all()
    assert (media.decode(b"P3 1 1 255 1 2 3") == [[[1, 2, 3]]]).all()
    assert media.features(b"no image") == {"height": None, "width": None, "dhash": None, "tile": None}


def test_media_features_by_plain_loops():
    """Tile and difference hash against area means summed pixel by pixel."""
    image = np.random.default_rng(2).integers(0, 256, (11, 24)).astype(np.uint8)
    found = media.features(media.encode_pgm(image.tobytes()))

    def cells(rows, columns):
        out = np.zeros((rows, columns))
        for r in range(rows):
            for c in range(columns):
                y0, y1, x0, x1 = r * 11 / rows, (r + 1) * 11 / rows, c * 24 / columns, (c + 1) * 24 / columns
                for y in range(11):
                    for x in range(24):
                        out[r, c] += image[y, x] * max(0, min(y + 1, y1) - max(y, y0)) * max(0, min(x + 1, x1) - max(x, x0))
                out[r, c] /= (y1 - y0) * (x1 - x0)
        return out

    tile = np.load(io.BytesIO(found["tile"]))[:, :, 0]
    assert abs(tile - cells(16, 16)).max() <= 0.5 + 1e-6
    small = cells(8, 9)
    bits = "".join(str(int(round(small[r, c], 6) < round(small[r, c + 1], 6))) for r in range(8) for c in range(8))
    assert found["dhash"] == f"{int(bits, 2):016x}"


def test_redact_of_overlapping_and_many_spans(spark):
    many = " ".join(f"a{i}@b.org" for i in range(3000))
    rows = [(1, "to +49 (0)30 1234567 or 10.0.0.1, me@x.org"), (2, many), (3, None), (4, ""), (5, "ip 1.2.3.4@host.org end")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, spans string")
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert out[2].text == " ".join(["[EMAIL]"] * 3000) and out[3].text is None and out[4].text == "" and out[1].spans == "s"
    for i, text in rows[:1] + rows[4:]:
        spans = sorted(((s["start"], s["end"], s["kind"]) for s in pii.find(df.where(f"doc_id = {i}").drop("spans")).first().spans), key=lambda s: s[0])
        at, made = 0, ""
        for a, b, kind in spans:
            if a >= at:
                made += text[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        assert out[i].text == made + text[at:]
