"""Token ids of texts under the byte-level BPE vocabulary of 50,257 ids."""

from __future__ import annotations

import base64
import json
import re
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

from .texthash import BASE, BASE_INVERSE, PLACES, SPACE, flat, mix, powers

VOCABULARY = "byte_bpe_50k"
END_ID = 2
#: White space that the vocabulary's pattern knows besides 0x20 and 0x09-0x0D. Texts that hold any are encoded in one go.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def vocabulary_path(name: str = f"{VOCABULARY}.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Pieces in a worker's table (about 50 bytes each); beyond that it starts anew.
CACHE = 200_000


class Known:
    """Ids of pieces met before, by the pieces' 64-bit hashes in order."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.first = self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def add(self, place: np.ndarray, hashes: np.ndarray, ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        self.hashes = np.insert(self.hashes, place, hashes)
        self.first = np.insert(self.first, place, first + len(self.ids))
        self.size = np.insert(self.size, place, size)
        self.ids = np.concatenate((self.ids, ids))


@cache
def added_tokens(ranks_path: str) -> dict[str, int]:
    """Added tokens that the vocabulary's JSON file, beside the rank file, lists: their strings in a text are theirs alone."""
    listed = Path(ranks_path).with_suffix(".json")
    return {t["content"]: int(t["id"]) for t in json.loads(listed.read_text())["added_tokens"]} if listed.exists() else {}


@cache
def encoder(ranks_path: str) -> tuple[tiktoken.Encoding, np.ndarray, Known]:
    """The encoder of a rank file, the bytes that each id stands for, and the worker's table. From the rank file of
    ``byte_bpe_50k`` it gives the ids of ``byte_bpe_50k.json`` (the tests compare them) in less
    time, added tokens included."""
    import public_tokenizers

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(ranks_path)), sizes, Known()


def token_ids(texts: pa.Array, ranks_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, end to end, and the offsets of each text's; null counts as empty.

    The pattern never lets a token reach from other characters into white space after them, so
    a text's ids are those of its pieces, each a run of white space with the run of other
    characters that follows. Each distinct piece is encoded once, unless the table was full.
    """
    encoding, token_bytes, known = encoder(ranks_path)
    data, offsets = flat(texts)
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    space = SPACE[data]
    start = np.zeros(len(data) + 1, dtype=bool)
    start[offsets] = True
    start[1:-1] |= space[1:] & ~space[:-1]
    a = np.flatnonzero(start[:-1])
    b = np.append(a[1:], len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(CODE[data] * powers(BASE, len(data))[: len(data)], out=total[1:])
    h = mix((total[b] - total[a]) * powers(BASE_INVERSE, len(data))[a] + (b - a).astype(np.uint64) * PLACES[11])
    h, at, which = np.unique(h, return_index=True, return_inverse=True)
    if len(known.hashes) > CACHE:
        known.clear()
    place = np.searchsorted(known.hashes, h)
    met = np.zeros(len(h), dtype=bool)
    inside = place < len(known.hashes)
    met[inside] = known.hashes[place[inside]] == h[inside]
    new = np.flatnonzero(~met)
    if len(new):
        ids, first, size = encode_pieces(encoding, token_bytes, data.tobytes(), a[at[new]], b[at[new]], space)
        known.add(place[new], h[new], ids, first, size)
        place = np.searchsorted(known.hashes, h)
    first, size, ids = known.first[place], known.size[place], known.ids
    n = size[which]
    ends = np.cumsum(n)
    out = ids[np.repeat(first[which] - (ends - n), n) + np.arange(ends[-1])]
    bounds = np.concatenate(([0], ends))[np.searchsorted(a, offsets)]
    odd = {i: t for i, t in enumerate(texts.to_pylist()) if t and OTHER_SPACE.search(t)} if has_other_space(data) else {}
    for token in added_tokens(ranks_path):
        odd |= {i: texts[i].as_py() for i in np.flatnonzero(pc.fill_null(pc.match_substring(texts, token), False)).tolist()}
    if odd:
        each = [np.array(encoding.encode(odd[i], allowed_special="all"), dtype=np.uint32) if i in odd else out[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        return np.concatenate(each), np.concatenate(([0], np.cumsum([len(x) for x in each])))
    return out, bounds


def forget(ranks_path: str) -> None:
    """Empty the worker's table: workers live on, and other stages need the memory."""
    encoder(ranks_path)[2].clear()


def encode_pieces(encoding: tiktoken.Encoding, token_bytes: np.ndarray, raw: bytes, a: np.ndarray, b: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the pieces ``raw[a:b]``, end to end, with each one's first place and number.

    They are encoded as one string. A piece without white space before it gets a line feed, which
    is one token; white space alone is encoded apart.
    """
    bare, blank = ~space[a], space[b - 1]
    joined = np.flatnonzero(~blank)
    text = b"".join([b"\n" + raw[i:j] if x else raw[i:j] for i, j, x in zip(a[joined].tolist(), b[joined].tolist(), bare[joined].tolist(), strict=True)])
    parts = [np.array(encoding.encode_ordinary(text.decode("utf-8")), dtype=np.uint32)]
    stop = np.searchsorted(np.cumsum(token_bytes[parts[0]]), np.cumsum((b - a)[joined] + bare[joined])) + 1
    first, size = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
    first[joined] = np.concatenate(([0], stop[:-1]))[: len(stop)] + bare[joined]
    size[joined] = stop - first[joined]
    n = len(parts[0])
    for k in np.flatnonzero(blank).tolist():
        parts.append(np.array(encoding.encode_ordinary(raw[a[k] : b[k]].decode("utf-8")), dtype=np.uint32))
        first[k], size[k] = n, len(parts[-1])
        n += len(parts[-1])
    return np.concatenate(parts), first, size


#: First bytes in UTF-8 of the characters of OTHER_SPACE.
LEADS = np.zeros(256, dtype=bool)
LEADS[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: One more than each byte, so that zero bytes count in a hash.
CODE = np.arange(1, 257, dtype=np.uint64)


def has_other_space(data: np.ndarray) -> bool:
    return bool(LEADS[data].any())
