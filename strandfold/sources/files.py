"""Which files to read and what to call the results."""

from __future__ import annotations

from strandfold.sources import storage

KINDS = {".fastq.gz": "fastq", ".fq.gz": "fastq", ".fastq": "fastq", ".fq": "fastq", ".bam": "bam"}


def kind(path: str) -> str | None:
    return next((k for end, k in KINDS.items() if path.endswith(end)), None)


def gather(path: str) -> list[tuple[str, str]]:
    """(file, kind) of one file, or of the files right in a folder, by name; others in a folder are passed over.

    path may be a URI. A lone file of an unknown kind is an error.
    """
    if storage.is_dir(path):
        return [(f, k) for f in storage.files(path) if (k := kind(f))]
    if not storage.is_file(path):
        raise FileNotFoundError(path)
    if not (k := kind(path)):
        raise ValueError(f"neither FASTQ nor BAM: {path}")
    return [(path, k)]


def output_name(path: str, suffix: str, outdir: str | None = None) -> str:
    """The name with _suffix before its last extension."""
    folder, _, name = path.rpartition("/")
    stem, dot, end = name.rpartition(".")
    new = f"{stem}_{suffix}.{end}" if dot else f"{name}_{suffix}"
    return storage.join(folder if outdir is None else outdir, new)


def report_name(path: str, tool: str, outdir: str) -> str:
    return storage.join(outdir, f"{path.rpartition('/')[2].split('.')[0]}_{tool}_report.tsv")
