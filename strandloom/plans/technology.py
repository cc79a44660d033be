"""What is fixed about sequencing technologies (fixed values)."""

from __future__ import annotations

#: Ends of transcripts that a technology's reads favour.
STRAND_BIAS = {
    "10XV1": ("5p", "3p"), "10XV2": ("5p", "3p"), "10XV3": ("5p", "3p"), "10XV3_ULTIMA": ("5p", "3p"), "BDWTA": ("3p",), "BULK": None,
    "CELSEQ": ("3p",), "CELSEQ2": ("3p",), "DROPSEQ": ("3p",), "INDROPSV1": ("3p",), "INDROPSV2": ("3p",), "INDROPSV3": ("3p",),
    "SCRUBSEQ": ("3p",), "SMARTSEQ2": None, "SMARTSEQ3": None, "SPLIT-SEQ": ("3p",), "STORMSEQ": ("3p",), "SURECELL": ("3p",), "VISIUM": ("3p",),
}

#: (file, start, end) of each part of a barcode; None: no barcode.
BARCODES = {
    "10XV1": [(0, 0, 14)], "10XV2": [(0, 0, 16)], "10XV3": [(0, 0, 16)], "10XV3_ULTIMA": [(0, 22, 38)], "BDWTA": [(0, 0, 9), (0, 21, 30), (0, 43, 52)],
    "BULK": None, "CELSEQ": [(0, 0, 8)], "CELSEQ2": [(0, 6, 12)], "DROPSEQ": [(0, 0, 12)], "INDROPSV1": [(0, 0, 11), (0, 30, 38)],
    "INDROPSV2": [(1, 0, 11), (1, 30, 38)], "INDROPSV3": [(0, 0, 8)], "SCRUBSEQ": [(0, 0, 6)], "SMARTSEQ2": None, "SMARTSEQ3": None,
    "SPLIT-SEQ": [(1, 10, 18), (1, 48, 56), (1, 78, 86)], "STORMSEQ": None, "SURECELL": [(0, 0, 6), (0, 21, 27), (0, 42, 48)], "VISIUM": [(0, 0, 16)],
}

#: Which file holds the transcript.
TRANSCRIPT_FILE = {
    "10XV1": 2, "10XV2": 1, "10XV3": 1, "10XV3_ULTIMA": 0, "BDWTA": 1, "BULK": 0, "CELSEQ": 1, "CELSEQ2": 1, "DROPSEQ": 1, "INDROPSV1": 1,
    "INDROPSV2": 0, "INDROPSV3": 2, "SCRUBSEQ": 1, "SMARTSEQ2": 0, "SMARTSEQ3": 0, "SPLIT-SEQ": 0, "STORMSEQ": 0, "SURECELL": 1, "VISIUM": 1,
}

#: (file, start, end) of the UMI, where it is known.
UMIS = {
    "10XV1": (1, 0, 10), "10XV2": (0, 16, 26), "10XV3": (0, 16, 28), "10XV3_ULTIMA": (0, 38, 50), "BDWTA": (0, 52, 60), "CELSEQ": (0, 8, 12),
    "CELSEQ2": (0, 0, 6), "DROPSEQ": (0, 12, 20), "INDROPSV3": (1, 8, 14), "SCRUBSEQ": (0, 6, 16), "SMARTSEQ3": (0, 11, 19), "SPLIT-SEQ": (1, 0, 10),
    "SURECELL": (0, 51, 59), "VISIUM": (0, 16, 28),
}


def known(technology: str) -> str:
    name = technology.upper()
    if name not in STRAND_BIAS:
        raise ValueError(f"unknown technology {technology!r}; known are {', '.join(sorted(STRAND_BIAS))}")
    return name


def strand_bias(technology: str, end: str | None = None) -> str | None:
    """The favoured end; it must be given where a technology has either."""
    ends = STRAND_BIAS[known(technology)]
    if ends is None:
        return None
    if end is None and len(ends) > 1:
        raise ValueError(f"{technology} can favour either end: give 5p or 3p")
    if end is not None and end not in ends:
        raise ValueError(f"{technology} favours {' or '.join(ends)}, not {end}")
    return end or ends[0]
