"""Fill-in-middle: documents cut into prefix, middle and suffix between tokens, by an indexable skip list.

The tokens of a text are the nodes of the list.  Every link of a lane carries how
many tokens and how many code points it passes, so a search for a cut walks the
lanes downwards by the tokens passed so far and comes out with the code points
before the cut; the text is cut there and never joined from tokens.

``restore`` undoes the transformation from the output and its form alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import mixed, text_parts

#: The markers of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts that become Python strings together.
BATCH_BYTES = 2_000_000


def token_widths(text: str) -> np.ndarray:
    """Code points of each token: white space with the run after it, or white space that ends the text."""
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    blank = (code == 32) | ((code >= 9) & (code <= 13))
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.diff(ends, prepend=0, append=len(code)) if len(code) else np.zeros(0, np.int64)


class SkipList:
    """Nodes with a width each, found by rank.

    ``lanes[0]`` has every node; a node is in the next lane with probability 1/4, by
    a hash of its position, and the first one is in all of them.  A lane holds three
    arrays: ranks passed by a link, width passed by it, and the node's place in the
    lane below.
    """

    def __init__(self, widths: np.ndarray):
        n = len(widths)
        height = mixed(np.arange(n, dtype=np.uint64))
        at = np.arange(n)
        self.lanes = [(np.ones(n, np.int64), widths, at)]
        while len(at) > 4:
            up = (height[at] & np.uint64(3)) == 0
            up[0] = True
            height >>= np.uint64(2)
            places = np.flatnonzero(up)
            if len(places) == len(at):
                break
            ranks, passed, _ = self.lanes[-1]
            self.lanes.append((np.add.reduceat(ranks, places), np.add.reduceat(passed, places), places))
            at = at[places]

    def width_before(self, rank: int) -> int:
        """Width of the first ``rank`` nodes."""
        node = ranks_so_far = width = 0
        for ranks, passed, below in reversed(self.lanes):
            while node < len(ranks) and ranks_so_far + ranks[node] <= rank:
                ranks_so_far += ranks[node]
                width += passed[node]
                node += 1
            if node == len(ranks):  # past the last link: all of the list
                break
            node = below[node]
        return int(width)


def transform(doc_id: int | None, text: str, seed: int, fim_percent: int, spm_percent: int) -> tuple:
    """Tokens, form, code points of prefix and middle (None if plain), and the output."""
    widths = token_widths(text)
    n = len(widths)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or h3 % 100 >= fim_percent or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    nodes = SkipList(widths)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = nodes.width_before(low), nodes.width_before(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """Per row: id, ``n`` tokens, ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    Cuts and form come from a hash of seed and id, so reruns and retries agree, and rows
    of one id and text get one output; a null id hashes as an empty one.  Null and
    empty texts are plain and empty, and so stay texts that hold a marker.  Every
    row stays; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            for ids, texts in text_parts(batch, BATCH_BYTES):
                rows = [transform(i, t, seed, fim_percent, spm_percent) for i, t in zip(ids.to_pylist(), texts)]
                n, form, prefix, middle, output = map(list, zip(*rows))
                yield pa.RecordBatch.from_pydict({
                    "id": ids, "n": pa.array(n, pa.int64()), "form": pa.array(form), "prefix_chars": pa.array(prefix, pa.int64()),
                    "middle_chars": pa.array(middle, pa.int64()), "output": pa.array(output, pa.string()),
                })

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return named.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def restore(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from.  A marker occurs once in it, as no text with one is cut."""

    def after(mark, text):
        return F.split_part(text, F.lit(mark), F.lit(2))

    def before(mark, text):
        return F.split_part(text, F.lit(mark), F.lit(1))

    middle = after(MIDDLE, output)
    psm = F.concat(before(SUFFIX, after(PREFIX, output)), middle, before(MIDDLE, after(SUFFIX, output)))
    spm = F.concat(before(MIDDLE, after(PREFIX, output)), middle, before(PREFIX, after(SUFFIX, output)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
