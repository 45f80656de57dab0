"""Token counts under an existing byte-level BPE vocabulary (ranks file), without training.

A text is cut into pieces by the vocabulary's pattern. Each distinct piece is merged once:
its bytes form a linked list of symbols, possible merges wait in a priority queue by rank,
stale entries are skipped, and the surviving symbols are counted. A text's count is the sum
over its pieces, weighted by their frequency. Counts of pieces are kept in a worker's memory
(bounded, then started anew), as pieces recur.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections import Counter

import regex

#: The vocabulary's pattern, as its README gives it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_FILE = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
_WHITE = r"\t-\r \x85\xa0  -     　"
_EXACT = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{_WHITE}\p{{L}}\p{{N}}]").replace(r"\s+(?!\S)|\s+", rf"[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"))
#: The same for texts without the characters of _UNUSUAL, in the faster engine.
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_UNUSUAL = re.compile(
    "[\x1c-\x1f" + "".join(re.escape(chr(c)) for c in range(0x80, 0x3400) if chr(c).isnumeric() and not chr(c).isdecimal()) + "㐀-鿿豈-﫿ꘀ-꛿\U00010000-\U0010ffff]"
)
_KEEP = 400_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file: one base64 token and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def pieces(text: str) -> list[str]:
    """The pieces the pattern cuts a text into."""
    return (_EXACT if _UNUSUAL.search(text) else _FAST).findall(text)


def surviving_symbols(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The symbols left of one piece when no merge is possible any more."""
    if piece in ranks:
        return [piece]
    n = len(piece)
    symbols: list[bytes | None] = [piece[k : k + 1] for k in range(n)]
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    queue: list[tuple[int, int, bytes]] = []

    def offer(left: int) -> None:
        right = after[left]
        if right >= 0 and (rank := ranks.get(both := symbols[left] + symbols[right])) is not None:
            heapq.heappush(queue, (rank, left, both))

    for k in range(n - 1):
        offer(k)
    while queue:
        _, left, both = heapq.heappop(queue)
        if symbols[left] is None or (right := after[left]) < 0 or symbols[left] + symbols[right] != both:
            continue  # one of the two was merged meanwhile
        symbols[left], symbols[right] = both, None
        after[left] = after[right]
        if after[right] >= 0:
            before[after[right]] = left
        if before[left] >= 0:
            offer(before[left])
        offer(left)
    return [s for s in symbols if s is not None]


class Counts:
    """Token counts of texts under one vocabulary."""

    def __init__(self, data: bytes):
        self.ranks = read_ranks(data)
        self.known: dict[str, int] = {}

    def of_piece(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= _KEEP:
                self.known.clear()
            n = self.known[piece] = len(surviving_symbols(piece.encode("utf-8", "replace"), self.ranks))
        return n

    def of_pieces(self, frequencies: Counter[str]) -> int:
        of = self.of_piece
        return sum(n * of(p) for p, n in frequencies.items())

    def of_text(self, text: str) -> int:
        return self.of_pieces(Counter(pieces(text)))


_loaded: dict[int, Counts] = {}


def worker_counts(broadcast) -> Counts:
    """The counts object of this worker process for a broadcast vocabulary file."""
    data = broadcast.value
    key = zlib.crc32(data) << 32 | zlib.adler32(data)  # of all bytes
    if key not in _loaded:
        _loaded.clear()  # one at a time is in use
        _loaded[key] = Counts(data)
    return _loaded[key]


def broadcast_file(spark, path: str = DEFAULT_FILE, most_bytes: int = 16_000_000):
    """The vocabulary file as a broadcast; its size is checked first."""
    with open(path, "rb") as f:
        data = f.read(most_bytes + 1)
    if len(data) > most_bytes:
        raise ValueError(f"{path} is larger than {most_bytes} bytes")
    return spark.sparkContext.broadcast(data)
