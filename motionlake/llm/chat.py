"""Chat formatting by token-level assembly.

Template of a turn, as text and as ids:

    <|role:R|> body <|end|>

Every segment (the role's name where it is not a usual one, the body) is encoded
on its own; the marks are reserved ids above the vocabulary and are spliced
between the segments, so no token ever spans a mark. The loss mask is a prefix
sum over +1 / -1 at the borders of the assistant bodies. Control strings inside a
text are escaped before it is encoded: an escape sign goes behind the first
character of each, and an escape sign of the text itself is doubled by a digit,
so the text read back is exactly the text put in.

One row per turn comes out, with ids, mask and the text; turns are formatted where
they lie. Only reading back a conversation as a whole needs its turns together:
they are sorted by (conversation, turn) and folded in a stream, so a
conversation of any length takes constant memory.

Defined cases: a null text is an empty body; a null role is an empty name, and
null roles and unusual ones are written out after the mark; null conversations or
turns sort first; turns with the same number are ordered by role and text;
repeated rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Control strings of usual chat templates, and our own marks.
CONTROL = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
    "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<|role:",
)
USUAL = ("system", "user", "assistant")
ESCAPE = "␛"  # U+241B

_STARTS = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")")
_CODED = re.compile(ESCAPE + "([01])")


def escape(text: str) -> str:
    """No control string is left in the result; unescape() gives the text again."""
    text = text.replace(ESCAPE, ESCAPE + "0")
    at = [m.start() + 1 for m in _STARTS.finditer(text)]
    if not at:
        return text
    ends = [0, *at, len(text)]
    return (ESCAPE + "1").join(text[a:b] for a, b in zip(ends, ends[1:]))


def unescape(text: str) -> str:
    return _CODED.sub(lambda m: ESCAPE if m[1] == "0" else "", text)


class Template:
    """Encodes turns with a byte-level vocabulary, and reads them back."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path)
        self.tok.encode_special_tokens = True
        size = self.tok.get_vocab_size()
        self.role_ids = {r: size + i for i, r in enumerate(USUAL)}
        self.other, self.body, self.end = size + 3, size + 4, size + 5
        self.role_of = {i: r for r, i in self.role_ids.items()}

    def _encoded(self, texts: list[str]) -> dict[str, list[int]]:
        """The ids of each distinct text."""
        each = list(dict.fromkeys(texts))
        return dict(zip(each, (e.ids for e in self.tok.encode_batch_fast(each, add_special_tokens=False))))

    def _decoded(self, ids: list[list[int]]) -> list[str]:
        return [unescape(t) for t in self.tok.decode_batch(ids, skip_special_tokens=False)]

    def assemble(self, roles: list[str], texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[str]]:
        """Ids, loss mask and formatted text of each turn."""
        flat, mask, starts, shown = self.assemble_all(roles, texts)
        return np.split(flat, starts[1:-1]), np.split(mask, starts[1:-1]), shown

    def read(self, ids: list[np.ndarray], masks: list[np.ndarray]) -> tuple[list[str], list[str], list[str]]:
        """Role, text and the text under the mask, of each turn."""
        return self.read_all(np.concatenate(ids), np.concatenate(masks), np.cumsum([0, *map(len, ids)]))

    def assemble_all(self, roles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Ids and loss mask of all turns, one after the other, where each turn begins (and the last ends), and each formatted text."""
        bodies = [escape(t) for t in texts]
        body_ids = self._encoded(bodies)
        heads = {r: [self.role_ids[r]] for r in USUAL}
        names = {r: escape(r) for r in set(roles)}
        odd = [r for r in names if r not in heads]
        name_ids = self._encoded([names[r] for r in odd])
        heads |= {r: [self.other, *name_ids[names[r]], self.body] for r in odd}
        flat, starts, edges = [], [0], []
        for role, body in zip(roles, bodies):
            flat += heads[role]
            opens = len(flat)
            flat += body_ids[body]
            if role == "assistant":
                edges.append((opens, len(flat)))
            flat.append(self.end)
            starts.append(len(flat))
        steps = np.zeros(len(flat) + 1, np.int8)
        if edges:
            opens, closes = np.array(edges).T
            steps[opens] += 1
            steps[closes] -= 1
        shown = [f"<|role:{names[r]}|>{b}<|end|>" for r, b in zip(roles, bodies)]
        return np.array(flat, np.int32), np.cumsum(steps[:-1], dtype=np.int8), np.array(starts), shown

    def read_all(self, flat: np.ndarray, mask: np.ndarray, starts: np.ndarray) -> tuple[list[str], list[str], list[str]]:
        """read() for turns that lie one after the other."""
        roles, names, bodies, kept = [], [], [], []
        masked = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[starts]
        for lo, hi, m in zip(starts[:-1].tolist(), starts[1:].tolist(), np.diff(masked).tolist()):
            first = int(flat[lo])
            at = lo + 1
            names.append([])
            if first == self.other:
                at = lo + 1 + int(np.flatnonzero(flat[lo:hi] == self.body)[0])
                names[-1] = flat[lo + 1 : at - 1].tolist()
            roles.append(self.role_of.get(first))
            bodies.append(flat[at : hi - 1].tolist())
            under = flat[lo:hi][mask[lo:hi].astype(bool)].tolist() if m else []
            kept.append(None if m and under == bodies[-1] else under)  # the same ids are read once
        texts = self._decoded(bodies)
        roles = [n if r is None else r for r, n in zip(roles, self._decoded(names))]
        rest = iter(self._decoded([k for k in kept if k is not None]))
        return roles, texts, [t if k is None else next(rest) for k, t in zip(kept, texts)]


@lru_cache(maxsize=4)
def template(tokenizer_path: str) -> Template:
    return Template(tokenizer_path)


def format_turns(turns: DataFrame, tokenizer_path: str, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """conv, turn, ids, mask, formatted: one row per turn, formatted where it lies."""
    rows = turns.select(
        turns[conv].alias("conv"),
        turns[turn].alias("turn"),
        F.coalesce(turns[role].cast("string"), F.lit("")).alias("role"),
        F.coalesce(turns[text].cast("string"), F.lit("")).alias("text"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = f"conv {kinds['conv']}, turn {kinds['turn']}, ids array<int>, mask array<tinyint>, formatted string"

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = template(tokenizer_path)
        for b in batches:
            flat, mask, starts, shown = t.assemble_all(b.column(2).to_pylist(), b.column(3).to_pylist())
            at = pa.array(starts, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (flat, mask)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists, pa.array(shown, pa.string())], ["conv", "turn", "ids", "mask", "formatted"])

    return rows.mapInArrow(formatted, out)


def conversation_digests(formatted: DataFrame, tokenizer_path: str, conv: str = "conv_id") -> DataFrame:
    """Read format_turns() back and fold each conversation in a stream over its sorted turns."""
    conv_type = formatted.schema["conv"].dataType.simpleString()
    read_schema = f"conv {conv_type}, turn {formatted.schema['turn'].dataType.simpleString()}, role string, text string, kept string, chars bigint"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = template(tokenizer_path)
        for b in batches:
            ids, mask = b.column(2), b.column(3)
            starts = ids.offsets.to_numpy()
            told = t.read_all(ids.flatten().to_numpy(), mask.flatten().to_numpy(), starts - starts[0])
            arrays = [*(pa.array(x, pa.string()) for x in told), pc.utf8_length(b.column(4)).cast(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], ["conv", "turn", "role", "text", "kept", "chars"])

    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        kind = None

        def close() -> None:
            if state is not None:
                n, turns, chars, loss, total = state
                done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def sent() -> pa.RecordBatch:
            arrays = [pa.array(x, k) for x, k in zip(zip(*done), [kind, *kinds])]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            kind = b.schema.field(0).type
            for conv, _, role, text, kept, chars in zip(*(x.to_pylist() for x in b.columns)):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(kept)
                state[3].update(kept.encode())
                state[4] += chars
            if len(done) >= 10_000:
                yield sent()
        close()
        if done:
            yield sent()

    back = formatted.mapInArrow(read, read_schema)
    met = back.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    out = f"conv {conv_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return met.mapInArrow(folded, out).withColumnRenamed("conv", conv)
