"""Ordinary texts are cut inside, so near copies share chunks."""

import random

from tamis.llm import media


def test_near_copies_share_chunks():
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000))
    chunks = []
    for t in (text, text[:500] + "X" + text[500:]):
        payload = media.payload_of(t)[1]
        ends = media.cut(payload)
        assert ends[-1] == len(payload) and ends == sorted(set(ends))
        chunks.append([payload[a:b] for a, b in zip([0, *ends], ends)])
    assert len(set(chunks[0]) & set(chunks[1])) >= len(chunks[0]) // 2 > 0
