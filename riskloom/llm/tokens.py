"""Byte-level BPE ids for whole batches of texts, each distinct word encoded once.

A space between two non-space characters always begins a pre-token, so a text is its first stretch and then stretches
" word"; distinct ones are encoded together and gathered back. Texts with other white space runs around a space are
encoded whole, and texts that hold the end-of-text string go to the tokenizer file itself, which knows it as special.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

MODEL, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
# Stretches gathered at once: a whole batch's places would be several times its text.
GATHER = 1 << 16


@lru_cache(maxsize=2)
def ranked(name: str = RANKS) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding and each id's length in bytes."""
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 2, np.int64)
    for token, k in ranks.items():
        lengths[k] = len(token)
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


@lru_cache(maxsize=2)
def whole(name: str = MODEL) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(name))


def encode_one(text: str) -> list[int]:
    if SPECIAL in text:
        return whole().encode(text, add_special_tokens=False).ids
    return ranked()[0].encode_ordinary(text)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """flat ids of stretches, their starts and counts, the stretch of each place, the places' begin by text."""
    encoding, lengths = ranked()
    split = pc.split_pattern(texts, " ")
    begins = split.offsets.to_numpy().astype(np.int64)
    begins = begins - begins[0]
    coded = split.flatten().dictionary_encode()
    del split
    place, distinct = coded.indices.to_numpy().copy(), coded.dictionary.to_pylist()
    del coded
    odd = np.fromiter((not w or w[0].isspace() for w in distinct), bool, len(distinct))
    usable = [w for w, o in zip(distinct, odd, strict=True) if not o]
    parts = (usable[k : k + GATHER // 4] for k in range(0, len(usable), GATHER // 4))
    ids = np.concatenate([np.empty(0, np.uint32), *(np.array(encoding.encode_ordinary(" " + " ".join(p)), np.uint32) for p in parts)])
    ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in usable), np.int64, len(usable)))
    upto = np.searchsorted(np.cumsum(lengths[ids]), ends, side="left") + 1
    starts, counts = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    counts[~odd] = np.diff(upto, prepend=0)
    starts[~odd] = upto - counts[~odd]
    first = begins[:-1]
    inner = np.ones(len(place), bool)
    inner[first] = False
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(begins))
    slow = np.zeros(len(texts), bool)
    slow[owner[odd[place] & inner]] = True
    slow |= pc.match_substring(texts, SPECIAL).to_numpy(zero_copy_only=False)
    heads = [encode_one(texts[k].as_py()) if slow[k] else encode_one(distinct[place[f]]) if distinct[place[f]] else [] for k, f in enumerate(first.tolist())]
    head_counts = np.fromiter(map(len, heads), np.int64, len(heads))
    head_starts = len(ids) + np.cumsum(head_counts) - head_counts
    place[inner & slow[owner]] = -1
    place[first] = len(distinct) + np.arange(len(texts))
    starts, counts = np.concatenate((starts, head_starts, [0])), np.concatenate((counts, head_counts, [0]))
    ids = np.concatenate((ids, np.fromiter((x for h in heads for x in h), np.uint32, int(head_counts.sum()))))
    return ids, starts, counts, place, begins


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts (string array, null: empty) to all their ids one after the other, and the number of ids of each."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    ids, starts, counts, place, begins = _words(texts)
    n = counts.astype(np.int32)[place]
    out, begin = np.empty(int(n.sum()), np.uint32), 0
    for k in range(0, len(place), GATHER):
        own = n[k : k + GATHER]
        upto = np.cumsum(own)
        out[begin : begin + upto[-1]] = ids[np.repeat(starts[place[k : k + GATHER]] - (upto - own), own) + np.arange(upto[-1])]
        begin += int(upto[-1])
    return out, np.add.reduceat(n, begins[:-1], dtype=np.int64)
