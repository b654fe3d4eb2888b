"""BPE against the tokenizers library; audio codecs against scalar versions and known codes."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from corpusmill.llm import bpe, media

from . import brute

PATH = public_tokenizers.path("byte_bpe_50k.json")


def strings():
    rnd = random.Random(4)
    odd = [chr(x) for x in [9, 10, 13, 28, 31, 32, 32, 0x85, 0xA0, 0x180E, 0x200B, 0x2003, 0x3000, 39, 115, 116, 97, 65, 49, 0x661, 0xE9, 0x4E2D, 0x1F600, 0x300, 0, 0xB2, 0xFEFF]]
    out = ["", " ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|> ", "a" * 3000, " " * 70, "don't I'LL we're"]
    out += ["".join(rnd.choice(odd) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    return out + ["".join(chr(rnd.choice([rnd.randint(0, 0x2FFF), rnd.randint(0, 127), rnd.randint(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(500)]


def test_bpe_equals_the_library():
    texts, ours, theirs = strings(), bpe.Codec(PATH), Tokenizer.from_file(PATH)
    for t, a, b in zip(texts, ours.encode_batch(texts), theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert a.tolist() == b.ids, t
        assert ours.decode(a).decode("utf-8", "replace") == theirs.decode(b.ids, skip_special_tokens=False)


def test_long_words_equal_the_library(monkeypatch):
    """Words over LONG bytes take the queue; with LONG 1, all do."""
    theirs = Tokenizer.from_file(PATH)
    rnd = random.Random(6)
    alphabets = ["ab", "a", "the", "aeioutn", "日本語テキスト", "မြန်မာစာ", "xyzé", "abcdefghijklmnopqrstuvwxyz"]
    for long, count, sizes in ((512, 60, (500, 1500)), (1, 800, (0, 30)), (512, 1, (64_000, 64_000))):
        monkeypatch.setattr(bpe, "LONG", long)
        ours = bpe.Codec(PATH)
        words = ["".join(rnd.choice(rnd.choice(alphabets[-2:]) if long > 1 and count == 1 else alphabets[k % 8]) for _ in range(rnd.randint(*sizes))) for k in range(count)]
        for w, ids in zip(words, ours.encode_batch(words), strict=True):
            assert ids.tolist() == theirs.encode(w, add_special_tokens=False).ids, w[:50]


def test_work_of_a_long_word_grows_with_its_length():
    rnd, ours = random.Random(2), bpe.Codec(PATH)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)).encode() for n in (64_000, 1_000_000)]
    start = time.process_time()
    ours.merge(words[:1])
    short = time.process_time() - start
    ours.merge(words[1:])
    assert short < 2 and time.process_time() - start - short < 16 * max(short, 0.2)


def test_known_words_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 10_000)
    ours = bpe.Codec(PATH)
    for k in range(30):
        ours.encode_batch([f"word{k}x{j}" for j in range(20)])
        assert sum(4 * len(w) + len(x) for w, x in ours.known.items() if isinstance(w, str)) < 10_000 + 60 * 300


def test_bpe_frames(spark):
    docs = brute.table(spark, [None, "", "hello world", "hello world", "é\n"])
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {0: "", 1: "", 2: "hello world", 3: "hello world", 4: "é\n"}
    rows = {r.doc_id: r for r in bpe.digests(docs).collect()}
    assert rows[0].n_tokens == 0 and rows[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[2][1:] == rows[3][1:]


def test_law_tables():
    mu, al = media.mulaw_table(), media.alaw_table()
    assert [int(mu[k]) for k in (0, 0x80, 0xFF, 0x7F)] == [-32124, 32124, 0, 0]
    assert [int(al[k]) for k in (0xD5, 0x55, 0x2A, 0xAA)] == [8, -8, -32256, 32256]
    assert len(set(al.tolist())) == 256


def test_adpcm_blocks():
    def scalar(b):
        v, i = int.from_bytes(bytes(b[:2]), "little", signed=True), min(int(b[2]), 88)
        out = [v]
        for x in b[4:]:
            for n in (int(x) & 15, int(x) >> 4):
                s = int(media.STEP_SIZES[i])
                d = (s >> 3) + (s if n & 4 else 0) + (s >> 1 if n & 2 else 0) + (s >> 2 if n & 1 else 0)
                v = max(-32768, min(32767, v - d if n & 8 else v + d))
                i = max(0, min(88, i + int(media.INDEX_STEPS[n & 7])))
                out.append(v)
        return out

    blocks = np.random.default_rng(2).integers(0, 256, (40, 64), dtype=np.uint8)
    assert media.decode_adpcm(blocks).tolist() == [scalar(b) for b in blocks]


def test_text_as_audio(spark):
    texts = [None, "", "x" * 64, "x" * 65, "é" * 400, "x" * 64]
    rows = {r.doc_id: r for r in media.digests(media.text_media(brute.table(spark, texts))).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        pad = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (rows[k].n_bytes, rows[k].payload_bytes, rows[k].payload_sha256) == (len(raw), len(pad), brute.sha(pad))
        assert rows[k].media_bytes == len(media.encode_text(raw)) and rows[k].media_sha256 == brute.sha(media.encode_text(raw))
    assert rows[2][1:] == rows[5][1:] and rows[0][1:] == rows[1][1:]
    pcm = media.text_media(brute.table(spark, ["hello"])).first().pcm
    assert media.parse_wav(bytes(pcm))[:2] == (media.PCM, 16000) and len(media.parse_wav(bytes(pcm))[3]) == 64 * 2 * 2


def test_laws_and_adpcm_become_pcm_of_twice_the_rate():
    rnd = np.random.default_rng(3)
    codes = rnd.integers(0, 256, 128, dtype=np.uint8)
    for kind, table in ((media.MULAW, media.mulaw_table()), (media.ALAW, media.alaw_table())):
        kind_out, rate, _, data = media.parse_wav(media.to_pcm16k(media.wav(kind, 8000, 8, codes.tobytes())))
        want = []
        for k, c in enumerate(codes):
            after = codes[min(k + 1, len(codes) - 1)]
            want += [int(table[c]), (int(table[c]) + int(table[after])) >> 1]
        assert (kind_out, rate) == (media.PCM, 16000) and np.frombuffer(data, "<i2").tolist() == want
    blocks = rnd.integers(0, 256, (3, 64), dtype=np.uint8)
    plain = media.decode_adpcm(blocks).ravel()
    file = media.wav(media.ADPCM, 8000, 4, blocks.tobytes(), 64)
    assert np.frombuffer(media.parse_wav(media.to_pcm16k(file))[3], "<i2")[0::2].tolist() == plain.tolist()


def test_a_text_longer_than_a_run_of_texts(spark):
    text = "0123456789abcdé\n" * 60_000
    raw = text.encode()
    pad = raw + b"\0" * (-len(raw) % 64)
    rows = media.digests(media.text_media(brute.table(spark, ["a", text, "b"]))).collect()
    assert {r.doc_id: (r.n_bytes, r.payload_sha256) for r in rows}[1] == (len(raw), brute.sha(pad))
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in bpe.digests(brute.table(spark, ["a", text, "b"])).collect()}
    assert got[1] == (len(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids), brute.sha(text))
