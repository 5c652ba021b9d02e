"""Records of archives that are larger than the reader's window."""

import io
import random

import pytest

from metrika.llm import warc


@pytest.mark.parametrize("chunk", [1 << 16, 1 << 11])
def test_every_record_of_a_large_archive(chunk, monkeypatch):
    monkeypatch.setattr(warc, "_CHUNK", chunk)
    rng = random.Random(5)
    parts, want, at = [], [], 0
    for i in range(4000):
        payload = bytes(rng.randrange(32, 127) for _ in range(rng.randint(200, 1600)))
        parts.append(warc.record(i, f"http://host/{i}", payload))
        want.append((at, i, payload))
        at += len(parts[-1])
    assert at > 3 << 20
    stream = io.BytesIO(b"".join(parts))
    for span in (at, 300_000):
        got = []
        for start in range(0, at, span):
            got += [(o, int(f["warc-record-id"].split(":")[-1].rstrip(">")), p) for o, f, p in warc.scan_range(stream, at, start, min(at, start + span))]
        assert got == want


def test_a_record_at_every_place_near_a_windows_end():
    data = warc.record(1, "http://host/1", b"some payload " * 9)
    window = 16 * warc._CHUNK
    for left in range(1, len(data) + 2):
        stream = io.BytesIO(b"\0" * (window - left) + data)
        got = list(warc.scan_range(stream, window - left + len(data), 0, window + 1))
        assert [(o, p) for o, _, p in got] == [(window - left, b"some payload " * 9)]
