"""Encoders of characters as numbers and decoders of numbers as characters, by one contract each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CHARACTERS = "0123456789abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Encoder:
    """How a text becomes numbers.

    before, after: special tokens that the dictionary has ahead of and behind its characters. start, end: tokens around
    the numbers. pad: what fills up to the text's limit plus extra. room: texts with more than limit - room numbers are
    dropped (null). unknown: token for characters that the dictionary lacks; they are left out if it is None.
    """

    before: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    start: str | None = None
    end: str | None = None
    pad: str | int = 0
    room: int = 0
    extra: int = 0
    unknown: str | None = None
    checks: bool = True
    cut: bool = False

    def dictionary(self, characters: str = CHARACTERS) -> list[str]:
        return [*self.before, *characters, *self.after]

    def number(self, token: str | int, characters: str = CHARACTERS) -> int:
        return token if isinstance(token, int) else self.dictionary(characters).index(token)


ENCODERS = {
    "ctc": Encoder(before=("blank",)),
    "attention": Encoder(("sos",), ("eos",), "sos", "eos", 0, room=1),
    "seed": Encoder((), ("eos", "padding", "unknown"), None, "eos", "padding", room=1),
    "srn": Encoder((), ("sos", "eos"), None, None, "eos"),
    "sar": Encoder((), ("<UKN>", "<BOS/EOS>", "<PAD>"), "<BOS/EOS>", "<BOS/EOS>", "<PAD>", room=2),
    "satrn": Encoder((), ("<UKN>", "<BOS/EOS>", "<PAD>"), "<BOS/EOS>", "<BOS/EOS>", "<PAD>", unknown="<UKN>", checks=False, cut=True),
    "pren": Encoder(("<PAD>", "<EOS>", "<UNK>"), (), None, "<EOS>", "<PAD>", room=1, unknown="<UNK>"),
    "nrtr": Encoder(("blank", "<unk>", "<s>", "</s>"), (), "<s>", "</s>", 0, room=2),
    "parseq": Encoder(("[E]",), ("[B]", "[P]"), "[B]", "[E]", "[P]", room=3),
    "vitstr": Encoder(("<s>", "</s>"), (), "<s>", "</s>", "<s>", room=1, extra=2),
    "abinet": Encoder(("</s>",), (), None, "</s>", 100, room=1, extra=1),
    "spin": Encoder(("sos", "eos"), (), "sos", "eos", 0, extra=2),
    "cppd": Encoder(("</s>",), (), None, "</s>", 100, room=1, extra=1),
}


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is computed once, however often then names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def numbers(text: Column, encoder: Encoder, limit: int = 25, characters: str = CHARACTERS, lower: bool = False) -> Column:
    """A text's characters as numbers; null where it is empty, longer than limit (both before anything is left out), or nothing is left."""
    known = encoder.dictionary(characters)
    table = F.create_map(*[F.lit(x) for i, c in enumerate(known) if c in characters for x in (c, i)])
    chars = F.split(F.lower(text) if lower else text, "")
    found = F.transform(chars, lambda c: F.element_at(table, c))
    if encoder.unknown:
        found = F.transform(found, lambda n: F.coalesce(n, F.lit(encoder.number(encoder.unknown, characters))))
    else:
        found = F.filter(found, lambda n: n.isNotNull())
    fits = F.length(text) > 0
    if encoder.checks:
        fits = fits & (F.length(text) <= limit)
    return F.when(fits, once(found, lambda n: F.when(F.size(n) > 0, n)))


def encode(text: Column, encoder: Encoder, limit: int = 25, characters: str = CHARACTERS, lower: bool = False) -> Column:
    """The padded sequence; null for texts that are dropped."""
    found = numbers(text, encoder, limit, characters, lower)
    around = [F.array(F.lit(encoder.number(t, characters))) for t in (encoder.start, encoder.end) if t]
    size, pad = limit + encoder.extra, F.lit(encoder.number(encoder.pad, characters))

    def padded(found: Column) -> Column:
        if encoder.checks:
            found = F.when(F.size(found) <= limit - encoder.room, found)
        return once(F.concat(*([around[0]] if encoder.start else []), found, *(around[-1:] if encoder.end else [])), lambda whole: F.concat(whole, F.array_repeat(pad, F.greatest(F.lit(0), size - F.size(whole)))))

    whole = once(found, padded)
    return F.slice(whole, 1, size) if encoder.cut else whole


def histogram(sequence: Column, size: int) -> Column:
    """How often each number from 0 up to size stands in a sequence, fills included; null for a null sequence."""

    @F.arrow_udf("array<int>")
    def counted(sequences: pa.Array) -> pa.Array:
        rows = np.repeat(np.arange(len(sequences)), sequences.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        values = sequences.flatten()
        there = values.is_valid().to_numpy(zero_copy_only=False)
        rows, found = rows[there], values.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        fits = (found >= 0) & (found < size)
        counts = np.bincount(rows[fits] * size + found[fits], minlength=len(sequences) * size)
        offsets = pa.array(np.arange(len(sequences) + 1) * size, pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()), mask=sequences.is_null())

    return counted(sequence)


@dataclass(frozen=True)
class Decoder:
    """What a sequence of numbers leaves: skip and stop are numbers; repeats: equal neighbours count once."""

    skip: tuple[int, ...] = ()
    stop: tuple[int, ...] = ()
    repeats: bool = False
    empty: float | None = None


def kept_steps(ids: Column, scores: Column, decoder: Decoder) -> Column:
    """(id, score) of the steps that speak: up to the first stop, without repeats of the step before, then without skipped ones."""
    steps = F.arrays_zip(ids.alias("id"), scores.alias("score"))
    if decoder.stop:
        first = F.array_min(F.filter(F.transform(ids, lambda x, i: F.when(x.isin(*decoder.stop), i)), lambda i: i.isNotNull()))
        steps = F.slice(steps, 1, F.coalesce(first, F.size(ids)))
    if decoder.repeats:
        steps = F.filter(steps, lambda s, i: (i == 0) | (s["id"] != F.get(ids, i - 1)))
    return F.filter(steps, lambda s: ~s["id"].isin(*decoder.skip)) if decoder.skip else steps


def decode(ids: Column, scores: Column, decoder: Decoder, dictionary: list[str]) -> tuple[Column, Column]:
    """(text, mean score) of a sequence; without steps the score is decoder.empty."""
    steps = kept_steps(ids, scores, decoder)
    letters = F.array(*map(F.lit, dictionary))
    text = F.array_join(F.transform(steps, lambda s: F.get(letters, s["id"].cast("int"))), "")
    total = F.aggregate(steps, F.lit(0.0), lambda a, s: a + s["score"])
    return text, F.when(F.size(steps) > 0, total / F.size(steps)).otherwise(F.lit(decoder.empty))
