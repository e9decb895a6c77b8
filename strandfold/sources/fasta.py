"""The first record of a FASTA file, plain or gzip."""

from __future__ import annotations

from strandfold.sources import storage


def first_record(path: str) -> tuple[str, str]:
    """(name, sequence)."""
    name, parts = None, []
    with storage.text_reader(path) as f:
        for raw in f:
            line = raw.decode("latin-1")
            if line.startswith(">"):
                if name is not None:
                    break
                name = line[1:].split()[0] if line[1:].split() else ""
            elif name is not None:
                parts.append(line.strip())
    if name is None:
        raise ValueError(f"no FASTA record in {path}")
    return name, "".join(parts)
