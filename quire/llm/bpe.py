"""BPE encoding and decoding with a trie over distinct words.

In byte-pair encoding with distinct merged tokens, a sequence of tokens is the encoding of its string exactly if each
neighbouring pair is the encoding of its own string. So for each prefix of a word there is one last token: the token t
that ends the prefix, and that may follow the last token of what is left without t. The distinct words of a batch are
walked as a trie, depth first: their sorted order visits it, a stack holds the last token of each prefix on the path,
and what two words share is computed once. A word's encoding is read back from the end along these last tokens.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fresh, raw_texts, release

#: Fixed values of the tokenizer: suffixes that stand alone, as its pattern has them.
CLITICS = "'s|'t|'re|'ve|'m|'ll|'d"
ASCII_WORDS = re.compile(rf"{CLITICS}|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
#: The same classes for texts up to U+00FF, where lower-casing and composition stay within that range.
LATIN_WORDS = re.compile(rf"{CLITICS}|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
#: Distinct words and pairs that a worker remembers, and characters of texts that it handles at once.
WORD_CACHE, PAIR_CACHE, CHUNK, LONG = 40_000, 100_000, 1_000_000, 200


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies show for each byte: itself if printable, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TrieBpe:
    """Encoder and decoder for a tokenizers file with word ends. A word is held as one character a byte; that of its last byte is moved up by 256."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        bare = spec | {"added_tokens": [], "post_processor": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}
        known = tokenizers.Tokenizer.from_str(json.dumps(bare))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        del spec, bare
        self.normaliser, self.splitter = known.normalizer, known.pre_tokenizer
        self.end = model["end_of_word_suffix"]
        if not self.end or model["dropout"] or model["ignore_merges"] or model["continuing_subword_prefix"]:
            raise ValueError("only plain BPE with word ends is known here")
        vocab: dict[str, int] = model["vocab"]
        self.letters = letters = byte_letters()

        def held(token: str) -> str:
            ends = token.endswith(self.end)
            word = "".join(chr(letters[c]) for c in (token[: -len(self.end)] if ends else token))
            return word[:-1] + chr(ord(word[-1]) + 256) if ends else word

        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        rank: dict[str, int] = {}  # base symbols first, then merged tokens in the order of their merges
        for b in range(512):
            rank[chr(b)] = b
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(512)]
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in merges:
            left, right, whole = held(a), held(b), held(a + b)
            if whole in rank:
                raise ValueError("two merges make one token")
            rank[whole] = len(self.parts)
            self.joined[rank[left], rank[right]] = len(self.parts)
            self.parts.append((rank[left], rank[right]))
        self.lengths = [0] * len(self.parts)
        self.ids = [0] * len(self.parts)
        back = {v: k for k, v in letters.items()}
        for word, r in rank.items():
            self.lengths[r] = len(word)
            last = ord(word[-1])
            shown = "".join(back[ord(c)] for c in word[:-1]) + back[last % 256] + (self.end if last >= 256 else "")
            self.ids[r] = vocab[shown]
        self.shown = {i: t.encode() for t, i in (vocab | self.special).items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        whole = [True] * len(self.parts)  # tokens that their own string encodes to
        for r in range(512, len(self.parts)):
            a, b = self.parts[r]
            whole[r] = whole[a] and whole[b] and self.follows(a, b, r)
        self._automaton({word: r for word, r in rank.items() if whole[r]})
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _automaton(self, tokens: dict[str, int]) -> None:
        """States for what a prefix ends with: the longest such string that begins a token. ends: the tokens, with their lengths, that end there."""
        self.step: dict[tuple[int, str], int] = {}
        letters, found, layer = [""], [-1], []
        for word, r in tokens.items():
            state = 0
            for c in word:
                if (to := self.step.get((state, c))) is None:
                    to = self.step[state, c] = len(letters)
                    letters.append(c)
                    found.append(-1)
                    layer.append((len(letters) - 1, state))
                state = to
            found[state] = r
        self.back = [0] * len(letters)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(letters)
        depth = [0] * len(letters)
        for state, parent in layer:
            depth[state] = depth[parent] + 1
        for state, parent in sorted(layer, key=lambda x: depth[x[0]]):
            if parent:
                self.back[state] = self.advance(self.back[parent], letters[state])
            own = ((found[state], depth[state]),) if found[state] >= 0 else ()
            self.ends[state] = own + self.ends[self.back[state]]

    def advance(self, state: int, letter: str) -> int:
        while (to := self.step.get((state, letter))) is None:
            if not state:
                return 0
            state = self.back[state]
        return to

    def follows(self, a: int, b: int, limit: int | None = None) -> bool:
        """Whether b stays beside a: no merge across their border comes before those that made them (or before limit)."""
        limit = len(self.parts) if limit is None else limit
        while True:
            if (made := self.joined.get((a, b))) is not None and made < limit:
                return False
            # Undo the later of the two merges; the border then lies between what was there before it.
            if a >= b and a >= 512:
                limit, a = min(limit, a), self.parts[a][1]
            elif b >= 512:
                limit, b = min(limit, b + 1), self.parts[b][0]
            elif a >= 512:
                limit, a = min(limit, a), self.parts[a][1]
            else:
                return True

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with its ids, as little-endian unsigned 32-bit integers."""
        order = sorted((h[:-1] + chr(ord(h[-1]) + 256), w) for w in words for h in (w.encode("utf-8", "surrogatepass").decode("latin-1"),))
        path, states = [], [0]
        before, step, back, ends, pairs, lengths = "", self.step, self.back, self.ends, self.pairs, self.lengths
        for word, given in order:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del path[shared:], states[shared + 1 :]
            state = states[shared]
            for end in range(shared, len(word)):
                letter = word[end]
                while (to := step.get((state, letter))) is None:
                    state = back[state]
                state = to
                for t, size in ends[state]:
                    if size > end:
                        break
                    pair = (path[end - size], t)
                    ok = pairs.get(pair)
                    if ok is None:
                        if len(pairs) >= PAIR_CACHE:
                            pairs.clear()
                        ok = pairs[pair] = self.follows(*pair)
                    if ok:
                        break
                path.append(t)
                states.append(state)
            before, at, found = word, len(word), array("I")
            while at:
                t = path[at - 1]
                found.append(self.ids[t])
                at -= lengths[t]
            found.reverse()
            yield given, found.tobytes()

    def split(self, text: str) -> list[str | int]:
        """The words of a text, after normalisation; an id in place of each special token."""
        if not any(s in text for s in self.special):
            return self._words(text)
        out: list[str | int] = []
        for piece in re.split("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")", text):
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                out += self._words(piece)
        return out

    def _words(self, text: str) -> list[str]:
        """The words of a text without special tokens. Beyond U+00FF the tokenizer's own normaliser and splitter say what is a letter, and how it is composed and lower-cased."""
        if text.isascii():
            return ASCII_WORDS.findall(text.lower())
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            letters = self.letters
            return [bytes([letters[c] for c in w]).decode() for w, _ in self.splitter.pre_tokenize_str(self.normaliser.normalize_str(text))]
        return LATIN_WORDS.findall(text.lower())

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers.

        Words are remembered in two generations of WORD_CACHE each; a word of the old one that comes again moves up.
        """
        split = [self.split(t) for t in texts]
        if len(self.young) > WORD_CACHE:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        for w in set().union(*split):
            if w not in young:
                if (ids := old.get(w)) is not None:
                    young[w] = ids
                elif isinstance(w, int):
                    young[w] = array("I", [w]).tobytes()
                else:
                    new.append(w)
        young.update(self.encode_words(new))
        out = [b"".join([young[w] for w in words]) for words in split]
        for w in new:
            if len(w) > LONG:
                del young[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, in UTF-8: this tokenizer has no decoder, so its tokens stand apart by a space."""
        return b" ".join(map(self.shown.__getitem__, array("I", ids)))


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> TrieBpe:
    return TrieBpe(path)


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    start, size, texts = 0, 0, []
    for i, raw in enumerate(raw_texts(batch.column(column))):
        texts.append(raw.decode("utf-8", "replace"))
        size += len(raw)
        if size >= CHUNK:
            yield batch.slice(start, i + 1 - start), texts
            start, size, texts = i + 1, 0, []
    if texts:
        yield batch.slice(start), texts


def encode(docs: DataFrame, path: str | None = None, text: str = "text", decode: bool = True) -> DataFrame:
    """docs with ids (binary: little-endian unsigned 32-bit integers) and, if asked for, decoded (their text).

    Columns of docs of these names are replaced. A null text counts as empty and has no ids and an empty decoded
    text; texts are encoded whole, however long, about CHUNK bytes at a time or one; repeated rows are kept; an empty
    table gives none.
    """
    path = path or default_path()
    kept = [c for c in docs.columns if c.lower() not in ("ids", "decoded")]
    name = fresh(docs.columns, "whole_text")
    given = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("string").alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        bpe = tokenizer(path)
        for batch in batches:
            at = batch.num_columns - 1
            for part, texts in _chunks(batch, at):
                ids = bpe.encode_batch(texts)
                columns = [*part.columns[:at], pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array([bpe.decode(i).decode() for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:at], "ids", *["decoded"] * decode])
        del bpe
        tokenizer.cache_clear()  # a worker that goes on to other work holds nothing of it
        release()

    schema = given.drop(name).schema.add("ids", "binary")
    return given.mapInArrow(run, schema.add("decoded", "string") if decode else schema)
