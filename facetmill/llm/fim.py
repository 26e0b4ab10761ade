"""Fill-in-the-middle transformation of whole texts, held as ropes.

A text is a sequence of units (white space with the word that follows it; white space alone at the end). A rope is a
balanced binary tree whose leaves hold stretches of the text and cache how many units and code points they have, and whose
inner nodes cache the sums. Two splits at unit ranks give prefix, middle and suffix as trees of their own; concatenating
them in another order with sentinels between gives the transformed text without touching most of the leaves. The inverse
finds the sentinels, splits the tree of the transformed text at their code-point ranks and concatenates the parts in the
text's order. Trees stay balanced in height, so a split or a concatenation visits a logarithmic number of nodes.

Which texts are transformed, the two ranks and the form follow from a hash of seed and doc_id alone: reruns agree, and
repeated rows get equal results. A text stays plain if it is empty or null (empty then), or holds a sentinel. A null doc_id
counts as the empty string in the hash. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import small_batches

_UNIT = re.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
#: Units of a leaf.
LEAF = 256
_LEAF = re.compile(r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){%d}" % LEAF)
#: The order of the parts behind their sentinels.
FORMS = {"psm": "PSM", "spm": "SPM"}


@dataclass(frozen=True)
class FimConfig:
    seed: int = 42
    #: Percentage of texts that are transformed, and of those that begin with the suffix.
    rate: int = 50
    spm: int = 80
    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")

    def mark(self, part: str) -> str:
        return self.sentinels["PSM".index(part)]


class Rope:
    """A leaf has text, an inner node has left and right."""

    __slots__ = ("left", "right", "text", "units", "chars", "height")

    def __init__(self, text: str, units: int):
        self.left = self.right = None
        self.text, self.units, self.chars, self.height = text, units, len(text), 0

    @staticmethod
    def node(left: Rope, right: Rope) -> Rope:
        out = Rope.__new__(Rope)
        out.left, out.right, out.text = left, right, None
        out.units, out.chars, out.height = left.units + right.units, left.chars + right.chars, 1 + max(left.height, right.height)
        return out

    @staticmethod
    def of(text: str) -> Rope | None:
        """The rope of a text; None if it is empty."""
        leaves, at = [], 0
        while m := _LEAF.match(text, at):
            leaves.append(Rope(m[0], LEAF))
            at = m.end()
        if at < len(text):
            rest = text[at:]
            leaves.append(Rope(rest, sum(1 for _ in _UNIT.finditer(rest))))

        def tree(a: int, z: int) -> Rope:
            return leaves[a] if z - a == 1 else Rope.node(tree(a, (a + z) // 2), tree((a + z) // 2, z))

        return tree(0, len(leaves)) if leaves else None

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            node = stack.pop()
            if node.text is None:
                stack += (node.right, node.left)
            else:
                yield node.text


def concat(a: Rope | None, b: Rope | None) -> Rope | None:
    """One tree of two: the lower one joins the other's spine where their heights meet, with rotations on the way back."""
    if a is None or b is None:
        return a if b is None else b
    if abs(a.height - b.height) <= 1:
        return Rope.node(a, b)
    if a.height > b.height:
        return _balanced(a.left, concat(a.right, b))
    return _balanced(concat(a, b.left), b.right)


def _balanced(a: Rope, b: Rope) -> Rope:
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return Rope.node(a.left, Rope.node(a.right, b))
        return Rope.node(Rope.node(a.left, a.right.left), Rope.node(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return Rope.node(Rope.node(a, b.left), b.right)
        return Rope.node(Rope.node(a, b.left.left), Rope.node(b.left.right, b.right))
    return Rope.node(a, b)


def split(rope: Rope | None, rank: int, by: str = "units") -> tuple[Rope | None, Rope | None]:
    """What lies before a rank (of units or chars) and what lies from it on."""
    if rope is None:
        return None, None
    size = getattr(rope, by)
    if rank <= 0:
        return None, rope
    if rank >= size:
        return rope, None
    if rope.text is None:
        inside = getattr(rope.left, by)
        if rank < inside:
            a, b = split(rope.left, rank, by)
            return a, concat(b, rope.right)
        a, b = split(rope.right, rank - inside, by)
        return concat(rope.left, a), b
    if by == "chars":
        at = rank
        before = sum(1 for _ in _UNIT.finditer(rope.text[:at]))
        return Rope(rope.text[:at], before), Rope(rope.text[at:], sum(1 for _ in _UNIT.finditer(rope.text[at:])))
    for i, m in enumerate(_UNIT.finditer(rope.text)):
        if i == rank:
            at = m.start()
            break
    return Rope(rope.text[:at], rank), Rope(rope.text[at:], rope.units - rank)


def draws(doc_id: object, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the hash of seed and doc_id."""
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return int(x[:8], 16), int(x[8:16], 16), int(x[16:24], 16), int(x[24:32], 16)


def rearranged(text: str, doc_id: object, cfg: FimConfig = FimConfig()) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, and the transformed text."""
    rope = Rope.of(text)
    n = rope.units if rope else 0
    h1, h2, h3, h4 = draws(doc_id, cfg.seed)
    if rope is None or h3 % 100 >= cfg.rate or any(s in text for s in cfg.sentinels):
        return n, "plain", None, None, text
    form = "spm" if h4 % 100 < cfg.spm else "psm"
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    rest, suffix = split(rope, z)
    prefix, middle = split(rest, a)
    parts, out = {"P": prefix, "S": suffix, "M": middle}, None
    for part in FORMS[form]:
        out = concat(concat(out, Rope(cfg.mark(part), 0)), parts[part])
    return n, form, prefix.chars if prefix else 0, middle.chars if middle else 0, "".join(out.leaves())


def restored(output: str, form: str, cfg: FimConfig = FimConfig()) -> str:
    """The text of a transformed text. Sentinels do not occur in the parts, so the first of each is the one that was set."""
    if form == "plain":
        return output
    order, rope, parts = FORMS[form], Rope.of(output), {}
    for part in reversed(order):
        rope, behind = split(rope, output.index(cfg.mark(part)), "chars")
        parts[part] = split(behind, len(cfg.mark(part)), "chars")[1]
    text = concat(concat(parts["P"], parts["M"]), parts["S"])
    return "".join(text.leaves()) if text else ""


def fill_in_middle(docs: DataFrame, cfg: FimConfig = FimConfig()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every document."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [rearranged(t or "", k, cfg) for k, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("doc_id").cast("string").alias("_k"), "text").mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(transformed: DataFrame, cfg: FimConfig = FimConfig()) -> DataFrame:
    """Adds text, rebuilt from form and output alone, to a table that has these two columns."""
    small_batches(transformed.sparkSession)
    names = [c for c in transformed.columns if c != "text"]
    form, output = names.index("form"), names.index("output")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [None if t is None else restored(t, f, cfg) for f, t in zip(b.column(form).to_pylist(), b.column(output).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, "text"])

    df = transformed.select(*names)
    return df.mapInArrow(run, StructType([*df.schema, StructField("text", StringType())]))
