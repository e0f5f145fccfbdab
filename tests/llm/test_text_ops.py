import hashlib
import random
import re
import zlib

import pandas as pd
import pytest

from sluicewire.llm import media, pii
from sluicewire.llm import substring as sub

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    parts = ["a", "b@", ".c", "1", "22", ".", "3.4", " ", "-", "+1", "(", "@", "a@b.c", "é", "4111 1111 1111 1111", "256.1.1.1", "+44 20 7946 0958"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert pii.base_spans(t)[0] == base(t), t


def test_validators_context_and_added_spans():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.iban_ok("DE89 3704 0044 0532 0130 00") and not pii.iban_ok("DE88 3704 0044 0532 0130 00")
    found = pii.find_spans("call +1 (578) 555-6437 4918187128635271 iban DE89 3704 0044 0532 0130 00")
    assert [(k, b) for k, _, _, _, b in found] == [("card", False), ("phone", False), ("iban", False)]
    plain, near = (pii.find_spans(t)[0][3] for t in ("x 4111111111111111", "card 4111111111111111"))
    assert near > plain
    assert [x[0] for x in pii.find_spans("ssn 123-45-6789")] == ["ssn"] and pii.find_spans("id 123-45-6789") == []
    # a linear scan: a quadratic one would take minutes
    assert pii.find_spans("a" * 200_000 + "1" * 200_000) == []


def test_cards_and_phones_inside_failed_proposals():
    found = lambda t, kind: [t[s:e] for k, s, e, *_ in pii.find_spans(t) if k == kind]
    for card in ("4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "3782 822463 10005", "378282246310005", "3056 930902 5904", "6304 0000 0000 0000 000"):
        assert pii.luhn(pii._digits(card))
        for before, after in (("2024 ", ""), ("", " 2023"), ("2024-01-01 ", " 17"), ("7 7 7 ", " 0000 1"), ("1234567890123456789012 ", "")):
            t = "x " + before + card + after + " y"
            assert any(card in x for x in found(t, "card")), t
            assert card not in pii.redact_text(t)
    # parted in no usual way: only near a telling word
    assert found("x 9999 41 11 11 11 11 11 11 11 9999 y", "card") == []
    assert any("41 11 11 11 11 11 11 11" in x for x in found("visa 9999 41 11 11 11 11 11 11 11 9999 y", "card"))
    assert found("2024 4111 1111 1111 1112 y", "card") == [] and found("1" * 20, "card") == []
    assert found("+44 20 7946 0958 2024-01-01", "phone") == ["+44 20 7946 0958"]
    assert found("tel +49 (30) 901820 123 4111 1111 1111 1111", "phone") == ["+49 (30) 901820 123"]
    assert found("+1 578 555 6437 2024-01-01", "phone") == ["+1 578 555 6437"]
    assert found("+4420794609582024", "phone") == [] and found("+44 2079", "phone") == []


def test_ibans_before_other_words():
    at, es, de, pl = "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00", "PL61 1090 1014 0000 0712 1981 2874"
    for iban in (at, es, de, pl, "NO93 8601 1117 947", "BE68 5390 0754 7034", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"):
        assert pii.iban_ok(iban) and len(iban.replace(" ", "")) == pii.IBAN_LENGTH[iban[:2]]
        for form in (iban, iban.replace(" ", "")):
            for after in ("", " ", ".", " EUR", " BIC", " 7", " BANK", " 2024", " BANK 2024", " BANK EUR", " BIC COBADEFF", " 2024 2025 2026 2027 2028", " and", ", EUR"):
                for before in ("", "to ", "AB12 CDEF "):
                    t = before + form + after
                    assert [t[s:e] for k, s, e, *_ in pii.find_spans(t) if k == "iban"] == [form], t
    assert pii.redact_text(f"pay {at} EUR or {es} BANK") == "pay <IBAN> EUR or <IBAN> BANK"
    # no country's code: mod 97 at the ends of groups
    check = next(f"{c:02}" for c in range(2, 99) if pii.iban_ok(f"ZZ{c:02} 1234 5678 9012 3456"))
    assert [e for k, _, e, *_ in pii.find_spans(f"ZZ{check} 1234 5678 9012 3456 KONTO")] == [24]
    assert not [x for x in pii.find_spans("AT62 1904 3002 3457 3201 EUR") if x[0] == "iban"]
    assert not [x for x in pii.find_spans("AT611904300234573201x") if x[0] == "iban"]


def test_redaction_keeps_rows_and_columns(spark):
    data = [(1, "mail a.b@c.de now", 17, "x"), (2, None, 4, None), (None, "clean", 5, "z"), (3, "", 0, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, n_chars long, spans string")
    got = pii.redact(df)
    assert got.columns == df.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "mail <EMAIL> now", 16, "x"), (2, None, 4, None), (None, "clean", 5, "z"), (3, "", 0, None)]))
    assert pii.redact(df.where("false")).count() == 0
    assert [len(r[0]) for r in df.orderBy("n_chars").select(pii.spans(df["text"])).collect()] == [0, 0, 0, 1]


def test_media_round_trip():
    rng = random.Random(4)
    for n in (0, 1, 575, 576, 577, 5000):
        data = rng.randbytes(n)
        audio = media.encode(data)
        p = media.probe(audio)
        back = media.payload(audio, p.offsets)
        assert back == data + b"\xff" * (len(back) - n) and len(back) % 576 == 0 and len(back) == max(576, -(-n // 576) * 576)
        assert (p.skipped, p.checksums_bad, p.table_frames, p.table_bytes, p.tags) == (0, 0, p.frames, len(audio) - p.offsets[0] + 672, {"payload_bytes": str(n)})
        assert p.samples == 1152 * p.frames and p.rate == 48000


def test_media_resynchronises_and_verifies():
    audio = media.encode(bytes(3000))
    p = media.probe(audio)
    cut = b"junk\xff\xfb\x00" * 3 + audio[p.offsets[1] + 100 :] + b"TAG" + b"title".ljust(125, b"\0")
    q = media.probe(cut)
    assert (q.frames, q.tags["title"]) == (p.frames - 2, "title") and q.skipped > 500
    bad = bytearray(audio)
    bad[p.offsets[0] + 8] ^= 1
    assert media.probe(bytes(bad)).checksums_bad == 1
    assert media.probe(None).frames == media.probe(b"").frames == 0 and media.probe(b"\xff" * 1000).skipped == 1000


def test_media_reads_vbr_tables_and_other_layers():
    h = bytes((0xFF, 0xFB, 0x90, 0x00))  # MPEG-1 Layer III, 128 kbit/s, 44.1 kHz, stereo, no checksum
    length = media.parse_header(h).length
    assert length == 417
    vbri = (h + bytes(32) + b"VBRI" + bytes(6) + (5000).to_bytes(4) + (11).to_bytes(4)).ljust(length, b"\0")
    p = media.probe(vbri + (h + bytes(length - 4)) * 3)
    assert (p.table, p.table_bytes, p.table_frames, p.frames, p.samples, p.mono) == ("VBRI", 5000, 11, 3, 3456, False)
    layer2 = media.parse_header(bytes((0xFF, 0xFD, 0x84, 0x00)))
    assert (layer2.layer, layer2.samples, layer2.length) == (2, 1152, 384)
    assert media.parse_header(bytes((0xFF, 0xFB, 0xF0, 0x00))) is None


MARKS = (b"TAG", b"ID3\4\0\0\0\0\0\x10", b"Info", b"Xing", b"VBRI", b"\xff\xfa\xc4\xc0", b"\xff\xfb\x90\0", media._LEAD)


@pytest.mark.parametrize("mark", MARKS)
def test_payloads_may_hold_tags_and_headers_anywhere(mark):
    for blocks in (1, 2):
        for at in range(576 * blocks - len(mark) + 1):
            data = (b"x" * at + mark).ljust(576 * blocks, b"y")
            audio = media.encode(data)
            p = media.probe(audio)
            assert media.payload(audio, p.offsets) == data and (p.skipped, p.checksums_bad, p.tags) == (0, 0, {"payload_bytes": str(len(data))})


def crc_of_bits(bits):
    crc = 0xFFFF
    for bit in bits:
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if (crc >> 15 ^ bit) & 1 else 0)
    return crc


def bits_of(data):
    return [b >> i & 1 for b in data for i in range(7, -1, -1)]


def test_media_checksums_of_layers_one_and_two():
    rng = random.Random(7)
    # Layer I at 48 kHz: stereo, joint from subband 8, mono; 4 bits for each allocation
    for mode, bits in ((0x00, 256), (0x50, 8 * 8 + 24 * 4), (0xC0, 128)):
        head = bytes((0xFF, 0xFE, 0xC4, mode))
        body = rng.randbytes(media.parse_header(head).length - 6)
        crc = crc_of_bits(bits_of(head[2:]) + bits_of(body)[:bits])
        for damage, bad in ((0, 0), (1, 2)):
            frame = head + (crc ^ damage).to_bytes(2) + body
            p = media.probe(frame * 2)
            assert (p.frames, p.layer, p.checksums, p.checksums_bad) == (2, 1, 2, bad)
    # Layer II, 192 kbit/s stereo at 48 kHz: 27 subbands, then two bits for each used channel
    head = bytes((0xFF, 0xFC, 0xA4, 0x00))
    body = rng.randbytes(media.parse_header(head).length - 6)
    every, x, used = bits_of(body), 0, 0
    for n in [4] * 11 + [3] * 12 + [2] * 4:
        for _ in range(2):
            used += any(every[x : x + n])
            x += n
    crc = crc_of_bits(bits_of(head[2:]) + every[: x + 2 * used])
    assert media.probe((head + crc.to_bytes(2) + body) * 2).checksums_bad == 0
    assert media.probe((head + crc.to_bytes(2) + bytes([body[0] ^ 16]) + body[1:]) * 2).checksums_bad == 2


def test_media_reads_older_tags_and_seek_tables():
    frame = media._LEAD + bytes(media.BLOCK) + media._REST
    tail = b"TT2" + (4).to_bytes(3) + b"\0abc" + b"TXX" + (6).to_bytes(3) + b"\0k\0\xff\0z"
    raw = b"ID3\2\0\x80" + media._syncsafe(len(tail)) + tail
    p = media.probe(raw + frame * 2)
    assert p.frames == 2 and p.tags["TT2"] == "abc" and p.skipped == 0
    own = b"\0\xff\0\xe0x"  # a frame that was unsynchronised by itself
    tail = b"TIT2" + media._syncsafe(len(own)) + b"\0\2" + own
    p = media.probe(b"ID3\4\0\0" + media._syncsafe(len(tail)) + tail + frame * 2)
    assert p.tags == {"TIT2": "\xff\xe0x"} and p.frames == 2
    audio = media.encode(bytes(3000))
    p = media.probe(audio)
    assert len(p.table_seek) == 100 and p.table_seek == sorted(p.table_seek) and p.table_seek[0] in range(600, 673)
    # a seek entry leads to the frame it stands for, within a 256th of the table's bytes
    first = p.offsets[0] - 672
    assert all(abs(first + x - p.offsets[len(p.offsets) * i // 100]) <= p.table_bytes / 256 for i, x in enumerate(p.table_seek))
    head = bytes((0xFF, 0xFB, 0x90, 0x00))
    length = media.parse_header(head).length
    vbri = head + bytes(32) + b"VBRI" + bytes(6) + (5000).to_bytes(4) + (3).to_bytes(4) + b"".join(x.to_bytes(2) for x in (3, 2, 2, 1, 100, 200, 300))
    assert media.probe(vbri.ljust(length, b"\0") + (head + bytes(length - 4)) * 3).table_seek == [200, 600, 1200]


def test_media_columns(spark):
    ddl = "doc_id long, text string, frames string, _result int, `a.b` int"
    df = spark.createDataFrame([(1, "héllo", "old", 5, 6), (2, None, None, None, None), (3, "", None, None, None), (3, "", None, None, None)], ddl).withColumn("m", media.encode_column("text"))
    got = media.probe_table(df, "m")
    assert got.columns == ["doc_id", "text", "_result", "a.b", "m", *media._PROBED]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[1]["tags"] == {"payload_bytes": "6"} and rows[2]["frames"] == rows[3]["frames"] == 1 and len(rows[1]["offsets"]) == 1 and (rows[1]["_result"], rows[1]["a.b"]) == (5, 6)
    assert got.count() == 4 and media.probe_table(df.where("false"), "m", ["doc_id"]).count() == 0


def stored_blocks(audio):
    """An independent reader of this one form: a tag, a table frame, then frames of 672 bytes."""
    assert audio[:3] == b"ID3"
    at = 10 + (audio[6] << 21 | audio[7] << 14 | audio[8] << 7 | audio[9]) + 672
    assert (len(audio) - at) % 672 == 0 and len(audio) > at
    return [audio[x + 23 : x + 599] for x in range(at, len(audio), 672)]


def test_media_query_recomputed(spark, tmp_path):
    rng = random.Random(12)
    letters = "aé漢🙂 \n"
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (1, 575, 576, 577, 4000, 300_000)] + ["x" * 521 + "TAG" + "y" * 52, "x" * 1097 + "TAG" + "y" * 52, None, "", "twice", "twice"]
    ids = [*range(len(texts) - 2), 90, 90]
    spark.createDataFrame([(i, t, "clash", 1) for i, t in zip(ids, texts)], "doc_id long, text string, media string, payload_bytes int").write.parquet(str(tmp_path / "documents.parquet"))
    got = media.op6_media_columns(spark, str(tmp_path)).collect()
    audio = {r["t"]: bytes(r["m"]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", media.encode_column("t").alias("m")).collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(ids)
    for r in got:
        text = texts[r["doc_id"]] if r["doc_id"] != 90 else "twice"
        data = (text or "").encode()
        want = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        stored = audio[text]
        assert b"".join(stored_blocks(stored)) == want
        assert tuple(r)[1:7] == (len(data), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert f"frames={len(want) // 576}:duration={len(want) // 576 * 1152}/48000:crc={len(want) // 576 + 1}/{len(want) // 576 + 1}:skipped=0:" in r["feature"]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert media.op6_media_columns(spark, str(tmp_path / "none")).count() == 0


def brute(docs, window):
    first, words = {}, []
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        words.append(w)
        for j in range(len(w) - window + 1 if d is not None else 0):
            x = tuple(w[j : j + window])
            first[x] = min(first.get(x, d), d)
    out = []
    for (d, _), w in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - window + 1 if d is not None else 0):
            if first[tuple(w[j : j + window])] < d:
                gone[j : j + window] = [True] * window
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def removed(spark, docs, window, k):
    got = sub.remove_repeats(spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, kept string"), window, k, digest=True).toPandas()
    return sorted([(None if pd.isna(d) else int(d), n, r, h) for d, n, r, h in got.itertuples(index=False)], key=str)


@pytest.mark.parametrize(("letters", "k", "unique"), [("abcdefghij", 3, True), ("ab", 3, False), ("abcd", 8, False)])
def test_substrings_equal_brute_force(spark, letters, k, unique):
    rng = random.Random(len(letters))
    passages = [[rng.choice(letters) for _ in range(60)] for _ in range(6)]
    docs = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(5)):
            a = rng.randrange(60)
            words += rng.choice(passages)[a : a + rng.randrange(30)] + [rng.choice("xyz")] * rng.randrange(2)
        docs.append((i if unique else rng.choice([i, i, i // 2, None]), " ".join(words)))
    assert removed(spark, docs, 8, k) == brute(docs, 8)


def test_substrings_of_nulls_long_texts_and_nothing(spark):
    long = " ".join(f"w{i * i % 1009}" for i in range(30_000))
    docs = [(1, long), (2, "start " + long + " end"), (3, None), (4, ""), (None, long), (5, "same " * 200), (6, "same " * 300)]
    assert removed(spark, docs, 50, 12) == brute(docs, 50)
    assert removed(spark, [], 50, 12) == []
    with pytest.raises(ValueError):
        sub.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), 5, 6)
