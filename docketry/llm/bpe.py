"""BPE encoding and decoding with batched numpy merge rounds.

Spark deals whole texts to tasks.  A task splits its texts into words, and all words it hasn't met yet are
encoded together: their symbols lie in one flat array, every round finds the rank of each neighbouring pair
by binary search over the sorted pair keys, and merges the lowest-ranked pair of every word at once.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from docketry.llm.common import blocks, only

#: Words that a task remembers; beyond that it forgets all and goes on.
REMEMBERED = 200_000
#: Characters of text whose words are encoded together.
BLOCK_CHARS = 1_500_000
#: Texts of characters below this alone are split by the standard library's engine, with classes spelt out.
NARROW = 0x250
WIDE = re.compile(f"[{chr(NARROW)}-\U0010ffff]")
NO_RANK = np.iinfo(np.int64).max


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: itself where printable, else one from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A lower-case BPE vocabulary with word ends, read from a tokenizers JSON file whose parts are checked."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError(f"{path} isn't a vocabulary of the kind this class encodes")
        self.tokens = {i: t for t, i in model["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # the vocabulary's own engine takes \s as the Unicode property, without the separators U+001C to U+001F
        self.words = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}"))
        vocab, chars = model["vocab"], byte_characters()
        classes = {"L": "", "N": "", "\\s": " \t\n\v\f\r\x85\xa0"}
        for c in map(chr, range(NARROW)):
            if (kind := unicodedata.category(c)[0]) in "LN":
                classes[kind] += c
        plain = pattern
        for name, members in classes.items():
            plain = plain.replace(f"\\p{{{name}}}" if name != "\\s" else name, re.escape(members))
        self.narrow = re.compile(plain)
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.final = np.array([vocab[c + "</w>"] for c in chars], dtype=np.int64)
        self.size = max(self.tokens) + 1
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made_by_rank = keys[order], order.astype(np.int64), made

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, found by binary search; NO_RANK where none."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NO_RANK)

    def _ranks_at(self, at: np.ndarray, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at the given places; a pair lies within one word."""
        after = np.minimum(at + 1, len(symbols) - 1)
        inside = (after > at) & (word[at] == word[after])
        return np.where(inside, self.pair_ranks(symbols[at], symbols[after]), NO_RANK)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word, all words merged together round by round."""
        raw = [w.encode("utf-8") for w in words]
        length = np.array([len(r) for r in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self.inner[data]
        last = np.cumsum(length) - 1
        symbols[last] = self.final[data[last]]
        word = np.repeat(np.arange(len(words)), length)
        rank = self._ranks_at(np.arange(len(symbols)), symbols, word)
        out_symbols, out_words = [], []
        while len(symbols):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            done = best == NO_RANK
            if done.any():
                out_symbols.append(symbols[done])
                out_words.append(word[done])
                open_ = ~done
                symbols, word, rank, best = symbols[open_], word[open_], rank[open_], best[open_]
            at = np.flatnonzero(rank == best)
            if not len(at):
                break
            # neighbours in a run of equal pairs overlap: take every other one, from the left
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[place % 2 == 0]
            symbols[at] = self.made_by_rank[rank[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            # only the pairs that a new symbol begins or ends have new ranks
            at -= np.arange(len(at))
            near = np.zeros(len(symbols), dtype=bool)
            near[at] = near[np.maximum(at - 1, 0)] = True
            changed = np.flatnonzero(near)
            rank[changed] = self._ranks_at(changed, symbols, word)
        if not out_words:
            return []
        symbols, word = np.concatenate(out_symbols), np.concatenate(out_words)
        symbols = symbols[np.argsort(word, kind="stable")]
        ends = np.cumsum(np.bincount(word, minlength=len(words)))
        ids = symbols.tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def split(self, text: str) -> list[str]:
        """The pieces to encode, in order: normalised words, and special tokens as they are."""
        out: list[str] = []
        for k, part in enumerate(self.at_special.split(text) if "<|" in text else [text]):
            if k % 2:
                out.append(part)
            elif part:
                # lower-casing goes character by character: no final sigma
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += (self.words if WIDE.search(part) else self.narrow).findall(part)
        return out

    def decode(self, ids) -> str:
        """Token texts joined by one space, as the library does for a vocabulary without a decoder."""
        return " ".join(self.tokens[int(i)] for i in ids)


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


class Encoder:
    """Encodes lists of texts and remembers, for each word, its ids and tokens as strings."""

    def __init__(self, bpe: WordBpe):
        self.bpe, self.ids, self.decoded = bpe, {}, {}
        self.id_text = {i: str(i) for i in bpe.tokens}

    def _learn(self, texts: list[list[str]]) -> None:
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
            self.decoded.clear()
        new = list(set().union(*texts).difference(self.ids, self.bpe.special))
        number, token = self.id_text, self.bpe.tokens
        for word, ids in zip(new, self.bpe.encode_words(new), strict=True):
            self.ids[word] = " ".join([number[i] for i in ids])
            self.decoded[word] = " ".join([token[i] for i in ids])
        for word, i in self.bpe.special.items():
            self.ids[word], self.decoded[word] = number[i], word

    def __call__(self, texts: list[str]) -> Iterator[tuple[str, str, int]]:
        """For each text: ids joined by spaces, decoded text, number of ids."""
        pieces = [self.bpe.split(t) for t in texts]
        self._learn(pieces)
        for words in pieces:
            ids = " ".join(map(self.ids.__getitem__, words))
            yield ids, " ".join(map(self.decoded.__getitem__, words)), ids.count(" ") + 1 if ids else 0


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encode and decode every whole text: the id column, ``n_tokens`` and the chosen outputs.

    ``outputs`` names any of ``ids`` (array), ``decoded`` (string), ``ids_sha256`` (of the decimal ids joined
    by a space) and ``decoded_sha256``.  Null and empty texts have no tokens.  Rows are independent: repeated
    rows give repeated results, an empty table gives none, and other columns are ignored.  No shuffle.
    """
    kinds = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"`{id_col}` {id_type}", "n_tokens long", *(f"{o} {kinds[o]}" for o in outputs)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(load(vocabulary))
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        make = {"ids": lambda i, d: list(map(int, i.split())), "decoded": lambda i, d: d, "ids_sha256": lambda i, d: sha(i), "decoded_sha256": lambda i, d: sha(d)}
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            made: list[list] = [[] for _ in range(1 + len(outputs))]
            for block in blocks(texts, len, BLOCK_CHARS):
                for ids, decoded, n in encode(block):
                    made[0].append(n)
                    for k, o in enumerate(outputs):
                        made[k + 1].append(make[o](ids, decoded))
            yield pd.DataFrame({id_col: batch[id_col], "n_tokens": made[0], **{o: made[k + 1] for k, o in enumerate(outputs)}})

    return only(docs, **{id_col: id_col, "text": text_col}).mapInPandas(run, schema)
