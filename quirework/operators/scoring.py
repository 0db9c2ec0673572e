"""Batches to model servers: what to do when a server refuses a batch or a text.

Plain functions around an injected call, used inside pandas or Arrow functions; nothing here knows a server.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

# Shorter forms of a text that an embedder refuses; a reranker's characters a document.
SHORTER = (900, 700, 500, 350)
RERANK_CHARS = 700


class Refused(Exception):
    """The server took the request and refused its content (status 400 or 500): shorter content may pass."""


def embed_all(texts: Sequence[str], call: Callable[[list[str]], list], shorter: Sequence[int] = SHORTER) -> tuple[list, dict[int, int]]:
    """(vectors in the texts' order, place -> length used of what had to be shortened).

    A refused batch is halved until single texts are left; a single text is tried at ever shorter lengths.  What is
    refused even then raises.  ``call`` gives (index, vector) pairs in any order.
    """
    out: list = [None] * len(texts)
    cut: dict[int, int] = {}

    def send(places: list[int], own: list[str]) -> None:
        for i, vector in call(own):
            out[places[i]] = vector

    work = [list(range(len(texts)))] if texts else []
    while work:
        places = work.pop()
        try:
            send(places, [texts[p] for p in places])
        except Refused:
            if len(places) > 1:
                half = len(places) // 2
                work += [places[half:], places[:half]]
                continue
            p = places[0]
            for n in shorter:
                if n < len(texts[p]):
                    try:
                        send([p], [texts[p][:n]])
                    except Refused:
                        continue
                    cut[p] = n
                    break
            else:
                raise
    return out, cut


def rerank_scores(query: str, documents: Sequence[str], call: Callable[[str, list[str]], list], budget: int = RERANK_CHARS) -> list[float]:
    """Scores in the documents' order; a refused request is sent again with half and a quarter of the characters."""
    if not documents:
        return []
    for size in (budget, budget // 2, budget // 4):
        try:
            scores = [0.0] * len(documents)
            for i, s in call(query, [d[:size] for d in documents]):
                scores[i] = float(s)
            return scores
        except Refused:
            if size == budget // 4:
                raise
    return []
