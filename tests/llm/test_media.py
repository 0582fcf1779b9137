"""Media columns: stored bytes, digests and fingerprints equal plain recomputation."""

import hashlib
import io
import wave
import zlib

from pyspark.sql import functions as F

from quarry.llm import media

TEXTS = [None, "", "a", "x" * 64, "x" * 65, "The quick brown fox. " * 200, "ünï ☃ " * 5000, "The quick brown fox. " * 200, "tone" * 40_000]


def stored(text):
    raw = (text or "").encode()
    raw += bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(media.RATE)
        w.writeframes(raw)
    return raw, out.getvalue()


def test_columns_equal_recomputation(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in media.described(media.media_columns(df, media=True)).collect()}
    for i, text in enumerate(TEXTS):
        raw, wav = stored(text)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len((text or "").encode()), len(raw), len(wav))
        assert r.payload_sha256 == hashlib.sha256(raw).hexdigest()
        assert r.tail_crc32 == zlib.crc32(raw[-64:])
        assert bytes(r.media) == wav and r.media_sha256 == hashlib.sha256(wav).hexdigest()
        assert len(r.fingerprint_code) == len(r.fingerprint_time) and r.fingerprint_time == sorted(r.fingerprint_time)
    assert rows[5].feature == rows[7].feature and rows[0].feature == rows[1].feature
    assert len({rows[i].feature for i in (1, 5, 6, 8)}) == 4


def plain_fingerprint(samples):
    """Frame by frame by the definition of the transform, pairs by loops."""
    import numpy as np

    n, window = len(samples), np.hanning(media.FRAME)
    peaks = []
    for lo in range(0, max(1, n - media.FRAME + media.HOP), media.HOP):
        frame = [samples[i] - 128 if i < n else 0 for i in range(lo, lo + media.FRAME)]
        size = np.abs(np.fft.rfft(np.array(frame) * window))
        top = [a + int(np.argmax(size[a:b])) for a, b in media.BANDS]
        peaks.append([(k if size[k] > size.mean() else None, size) for k in top])
        if lo + media.FRAME >= n:
            break
    pairs = []
    for t, own in enumerate(peaks):
        for band, (k, _) in enumerate(own):
            if k is None:
                continue
            if band + 1 < len(own) and own[band + 1][0] is not None:
                pairs.append((t, (k << 16) | (own[band + 1][0] << 4)))
            pairs += [(t, (k << 16) | (peaks[t + d][band][0] << 4) | d) for d in range(1, media.AHEAD + 1) if t + d < len(peaks) and peaks[t + d][band][0] is not None]
    return sorted(pairs)


def test_fingerprints_equal_recomputation(spark):
    texts = ["a", "Some words here.", "x" * 64, "The quick brown fox. " * 60, "mixed 123 text, with numbers; " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in media.media_columns(df).collect():
        want = plain_fingerprint(stored(texts[r.doc_id])[0])
        assert list(zip(r.fingerprint_time, r.fingerprint_code, strict=True)) == want
        assert want, texts[r.doc_id]


def test_fingerprint_finds_a_tone_and_ignores_blocks(monkeypatch):
    import numpy as np

    t = np.arange(40_000)
    tone = (128 + 100 * np.sin(2 * np.pi * t * 10 / media.FRAME)).astype(np.uint8).tobytes()
    code, time = media.fingerprint(tone)
    assert 10 in set((code >> 16).tolist())
    monkeypatch.setattr(media, "BLOCK", 7)
    again = media.fingerprint(tone)
    assert (again[0] == code).all() and (again[1] == time).all()


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a", "b"), (None, None, None)], "doc_id bigint, text string, n_bytes string")
    assert media.media_columns(df).count() == 2
    assert media.media_columns(df.where(F.lit(False))).collect() == []
