"""BPE encoding and decoding over a trie of distinct words.

A word's encoding is that of a shorter prefix and one last token, so each prefix needs its last token only. The
distinct words of a batch are walked in the depth-first order of their trie; the stack holds the last-token state of
each prefix on the current path, so a prefix that many words share is computed once. The last token of a
prefix is the one token t ending there such that the last token u of what stands before t and t themselves stay
apart when their symbols are merged; that test is by pair and is remembered. The tokens that end at a prefix are known
from the longest end of it that starts a token: the walk holds that state as well, and its steps are remembered.

``Bpe`` reads a tokenizer of the tokenizers library whose model is a BPE with word ends. Texts are cut at
spaces and line feeds, which its normaliser makes equal and its pre-tokenizer drops. Pieces and words are numbered by
Arrow; what a worker does not know is learnt, and ids and texts are gathered end to end. Patterns do the work of normaliser
and pre-tokenizer on PLAIN pieces (letters that compose with nothing, then ASCII marks) and on printable ASCII; the library's
own see the other distinct pieces. It expects the normaliser and pattern of the vocabulary file ``word_bpe_49k.json``
and refuses others.

Defined cases: null text is empty and has no ids; the strings of special tokens in a text are those tokens, as in
the library; rows pass whatever their id; repeated rows give repeated results; an empty table an empty table.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftlens.llm.common import BINARY, LONG, STRING, Pieces, apart, at, joined, lettered, merged, text_mapped

#: Distinct pieces, and distinct words, that a worker remembers, and remembered pair tests.
MOST_PIECES = 300_000
MOST_WORDS = 800_000
MOST_PAIRS = 400_000
MOST_STEPS = 200_000
#: Fixed value: the word pattern of the tokenizers that this reads.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What the library's normaliser and pre-tokenizer leave of printable ASCII, where letters are a-z once lower-cased.
#: Letters that no normaliser joins with what follows, then ASCII marks, in Arrow's patterns.
PLAIN = r"^(?P<word>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+)(?P<marks>[!-/:-@\[-`{-~]*)$"
PRINTABLE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


class Bpe:
    def __init__(self, spec: str):
        self.library = Tokenizer.from_str(spec)
        self.library.no_padding()
        self.library.no_truncation()
        j = json.loads(spec)
        cuts = [x.get("pattern", {}).get("Regex") for x in (j["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if PATTERN not in cuts or "Lowercase" not in [x["type"] for x in (j["normalizer"] or {}).get("normalizers", [])]:
            raise ValueError("not a tokenizer with lower-cased words and word ends")
        self.vocab: dict[str, int] = j["model"]["vocab"]
        self.end: str = j["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.rank: dict[tuple[str, str], int] = {}
        self.made: dict[str, tuple[str, str, int]] = {}
        for k, m in enumerate(j["model"]["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            self.rank[left, right] = k
            self.made[left + right] = (left, right, k)
        self.name = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.longest = max(map(len, self.vocab))
        self.starts = {t[:k] for t in self.vocab for k in range(1, len(t) + 1)}
        self.steps: dict[str, tuple[str, list[tuple[str, int]]]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.pieces = Pieces(self.learn, MOST_PIECES)
        # Words in the alphabet of bytes, as the pre-tokenizer gives them, and plain ones as they are.
        self.known = Pieces(lambda w: self.learn_words(w.to_pylist()), MOST_WORDS // 4)
        self.letters = Pieces(lambda w: self.learn_words(list(map(lettered, w.to_pylist()))), MOST_WORDS)

    def symbols(self, token: str) -> list[str]:
        """The characters a token starts from; a word end belongs to the last."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            stem = token[: -len(self.end)]
            return [*stem[:-1], stem[-1] + self.end]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain merging by rank, the first of equal ones first."""
        parts = list(symbols)
        while len(parts) > 1:
            best, k = min((self.rank.get(p, 1 << 60), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def apart(self, left: str, right: str) -> bool:
        """Whether two tokens next to each other stay as they are when their symbols are merged.

        Merging makes the parts at the boundary in the order of their ranks: those that end left (each
        until the rank at which the next longer one takes it) and those that start right. A merge over the boundary
        happens if its rank comes before both parts are taken; of equal ranks the one further left is first.
        """
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            starts = self.edge(right, 0)
            known = self.pairs[left, right] = not any(
                (k := self.rank.get((a, b))) is not None and k < until_a and k <= until_b for a, until_a in self.edge(left, 1) for b, until_b in starts
            )
        return known

    def edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The token and its first (side 0) or last (side 1) parts, each with the rank at which it is taken."""
        known = self.edges[side].get(token)
        if known is None:
            known, part, until = [], token, 1 << 60
            while True:
                known.append((part, until))
                if part not in self.made:
                    break
                until = self.made[part][2]
                part = self.made[part][side]
            self.edges[side][token] = known
        return known

    def alone(self, token: str) -> bool:
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merged(self.symbols(token)) == [token]
        return known

    def words(self, words: list[str]) -> list[list[str]]:
        """Tokens of each distinct word; words are strings of the pre-tokenizer, without word ends."""
        out: list[list[str]] = [[]] * len(words)
        last: list[str] = [""]  # last[d]: the last token of the path's prefix of d symbols
        state: list[str] = [""]  # state[d]: the longest end of it that starts a token
        steps, pairs, path, sizes = self.steps, self.pairs, "", len(self.end)
        for place in sorted(range(len(words)), key=words.__getitem__):
            word = words[place]
            inner = len(word) - 1
            shared, most = 0, min(len(path), inner)
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], state[shared + 1 :]
            path = word[:-1]
            at_ = state[shared]
            for d in range(shared + 1, inner + 1):
                key = at_ + word[d - 1]
                known = steps.get(key)
                at_, ends = known if known is not None else self.step(key)
                for token, n in ends:
                    if d == n or (ok := pairs.get((left := last[d - n], token))) or ok is None and self.apart(left, token):
                        last.append(token)
                        break
                else:
                    raise ValueError(f"no token ends {word[:d]!r}")
                state.append(at_)
            tail = self.tail(word, last)
            tokens, d = [tail], inner + 1 - (len(tail) - sizes)
            while d:
                tokens.append(t := last[d])
                d -= len(t)
            out[place] = tokens[::-1]
        return out

    def step(self, key: str) -> tuple[str, list[tuple[str, int]]]:
        """For a state and the next symbol: the state behind it, and the tokens that end there with their sizes, longest first."""
        state = next((key[k:] for k in range(len(key)) if key[k:] in self.starts), "")
        ends = [(state[k:], len(state) - k) for k in range(len(state)) if state[k:] in self.vocab and self.alone(state[k:])]
        if len(self.steps) >= MOST_STEPS:
            self.steps.clear()
        self.steps[key] = state, ends
        return state, ends

    def tail(self, word: str, last: list[str]) -> str:
        """The token that ends a word."""
        for k in range(max(0, len(word) - self.longest), len(word)):
            token = word[k:] + self.end
            if token in self.vocab and self.alone(token) and (not k or self.apart(last[k], token)):
                return token
        raise ValueError(f"no token ends the word {word!r}")

    def learn_words(self, words: list[str]) -> list[pa.Array]:
        """Ids (32-bit little-endian) and tokens' texts, a space before each, of distinct words."""
        tokens, vocab = self.words(words), self.vocab
        ids = [array("I", [vocab[t] for t in ts]).tobytes() for ts in tokens]
        return [pa.array(ids, pa.binary()), pa.array([" " + " ".join(ts) for ts in tokens], pa.string())]

    def learn(self, pieces: pa.Array) -> list[pa.Array]:
        """The same of distinct pieces."""
        normal, cut = self.library.normalizer, self.library.pre_tokenizer
        found = pc.extract_regex(pieces, PLAIN)
        plain, rest = found.is_valid(), pieces.filter(found.is_null())
        word, marks = (pc.utf8_lower(found.field(k).filter(plain)) for k in (0, 1))
        lists = pc.split_pattern(pc.binary_join_element_wise(word, pc.if_else(pc.equal(marks, ""), None, marks), "\n", null_handling="skip"), "\n")
        words, ends = [], [0]
        for p in rest.to_pylist():
            words += PRINTABLE.findall(p.lower()) if p.isascii() and p.isprintable() else [w for w, _ in cut.pre_tokenize_str(normal.normalize_str(p)) if w]
            ends.append(len(words))
        other = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.string()))
        parts = [(np.flatnonzero(plain), self.gathered(self.letters, lists)), (np.flatnonzero(found.is_null()), self.gathered(self.known, other))]
        return [merged(len(pieces), [(at_, x[k]) for at_, x in parts]) for k in (0, 1)]

    @staticmethod
    def gathered(known: Pieces, lists: pa.ListArray) -> list[pa.Array]:
        ids, texts = known.of(lists.values)
        return [joined(ids, lists), joined(texts, lists).cast(pa.string())]

    def sections(self, text: str) -> tuple[bytes, str]:
        """Ids and text of a text with the strings of special tokens in it."""
        got = []
        for k, s in enumerate(self.cut.split(text)):
            if k % 2:
                got.append((np.array([self.special[s]], "<u4").tobytes(), " " + s))
            else:
                got += zip(*(x.to_pylist() for x in self.plain(pa.array([s], pa.string()))), strict=True)
        return b"".join([i for i, _ in got]), "".join([t for _, t in got])

    def plain(self, texts: pa.Array) -> list[pa.Array]:
        return self.gathered(self.pieces, pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "))

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids (32-bit little-endian) and decoded text of whole texts."""
        return list(zip(*(x.to_pylist() for x in self.columns(pa.array(texts, pa.string()))), strict=True))

    def columns(self, texts: pa.Array) -> list[pa.Array]:
        """The same as columns."""
        texts = texts.fill_null("")
        special = pa.array(np.zeros(len(texts), bool))
        for s in self.special:
            special = pc.or_(special, pc.match_substring(texts, s))
        places = special.to_numpy(zero_copy_only=False)
        parts = [(np.flatnonzero(~places), self.plain(texts.filter(pc.invert(special))))]
        if places.any():
            got = [self.sections(t) for t in texts.filter(special).to_pylist()]
            parts.append((np.flatnonzero(places), [pa.array([i for i, _ in got], pa.binary()), pa.array([t for _, t in got], pa.string())]))
        ids, decoded = (merged(len(texts), [(at_, x[k]) for at_, x in parts]) for k in (0, 1))
        return [ids, pc.utf8_slice_codeunits(decoded, 1)]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False) without a decoder: tokens joined by spaces."""
        return " ".join([self.name[i] for i in ids])


_READY: dict[int, Bpe] = {}


def ready(spec: str) -> Bpe:
    """One encoder for each worker, so that tasks share what it has learnt."""
    key = hash(spec)
    if key not in _READY:
        _READY.clear()
        _READY[key] = Bpe(spec)
    return _READY[key]


def encoded(docs: DataFrame, tokenizer: str, keep: list[str] | None = None) -> DataFrame:
    """The documents with n_tokens, ids (binary, 32-bit little-endian) and decoded. tokenizer: path of its file.

    decoded is decoded from the ids of each piece, the pieces' texts joined by spaces as tokens are.
    """
    with open(tokenizer, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    place = at(docs, "text")
    docs = apart(docs, "n_tokens", "ids", "decoded", "_text")
    names, text = docs.columns, docs.columns[place]
    x = docs.select(*[F.col(f"`{c}`") for c in names if keep is None or c in keep], F.col(f"`{text}`").cast("string").alias("_text"))

    def make():
        coder = ready(sent.value)

        def run(texts):
            ids, decoded = coder.columns(texts)
            return [pc.divide(pc.binary_length(ids), 4).cast(pa.int64()), ids, decoded]

        return run

    return text_mapped(x, "_text", make, {"n_tokens": LONG, "ids": BINARY, "decoded": STRING}, [c for c in x.columns if c != "_text"], arrow=True)
