"""Words of texts as UTF-8 bytes: cut and lower-cased (A-Z only) by byte tables, in slices, so that a very long text is never a list of all its words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

_LOWER, _OTHER = bytes(range(0x61, 0x7B)), bytes(range(0x80, 0x100))


def byte_table(kept: bytes) -> bytes:
    """For bytes.translate: A-Z as a-z, the kept bytes as they are, all others as spaces."""
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in kept else 0x20 for b in range(256))


#: Runs of a-z and of all code points from U+0080 on.
LETTERS = byte_table(_LOWER + _OTHER)
#: The same with 0-9.
WORDS = byte_table(_LOWER + _OTHER + b"0123456789")
#: Bytes of a text that are cut at once.
SLICE = 1 << 22
#: Entries and bytes of texts after which a task hands on its counts.
MOST_ENTRIES, MOST_BYTES = 250_000, 1 << 27


def words_of(raw: bytes | None, kinds: bytes) -> Iterator[list[bytes]]:
    """The words of a text, slice by slice; null has none."""
    text, at = (raw or b"").translate(kinds), 0
    while at < len(text):
        end = text.find(b" ", at + SLICE) if len(text) - at > SLICE else -1
        end = len(text) if end < 0 else end
        if found := text[at:end].split():
            yield found
        at = end


def runs_of(raw: bytes | None, most: int) -> Iterator[tuple[list[bytes], int]]:
    """All runs of 1 to `most` consecutive words of a text, joined by a space, slice by slice, with the number of words in the slice."""
    before: list[bytes] = []
    for words in words_of(raw, WORDS):
        if most == 1:
            yield words, len(words)
            continue
        joined, first = before + words, len(before)
        runs = [b" ".join(joined[end - n : end]) for end in range(first + 1, len(joined) + 1) for n in range(1, min(most, end) + 1)]
        yield runs, len(words)
        before = joined[-(most - 1) :]


class Counts:
    """Counts of a task by group, handed on when they are many: what is shuffled has met its like in the task before."""

    def __init__(self):
        self.groups: dict[tuple, tuple[Counter, Counter]] = {}
        self.entries = self.bytes = 0

    def add(self, group: tuple, slices: Iterator[list[bytes]], size: int) -> None:
        """Of one text: each term's occurrences, and 1 for the text itself."""
        if group not in self.groups:
            self.groups[group] = Counter(), Counter()
        every, once = self.groups[group]
        seen: set[bytes] = set()
        known = len(every)
        for found in slices:
            every.update(found)
            seen.update(found)
        once.update(seen)
        self.entries += len(every) - known
        self.bytes += size

    def full(self) -> bool:
        return self.bytes > MOST_BYTES or self.entries > MOST_ENTRIES

    def take(self) -> Iterator[tuple[tuple, list[bytes], list[int], list[int]]]:
        """(group, terms, occurrences, texts), and begin anew."""
        for group, (every, once) in self.groups.items():
            terms = list(every)
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                yield group, part, [every[t] for t in part], [once[t] for t in part]
        self.groups, self.entries, self.bytes = {}, 0, 0
