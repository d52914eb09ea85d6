"""A plain reader of mzML by the XML library: what the split reader is compared with."""

import base64
import re
import xml.etree.ElementTree as ET
import zlib

import numpy as np


def scans(text: str, run: str) -> list[tuple]:
    """Rows of the spectra of levels 1 and 2 in the columns of readers.SCANS."""
    name = lambda e: e.tag.rpartition("}")[2]
    out = []
    for spectrum in (e for e in ET.fromstring(text).iter() if name(e) == "spectrum"):
        marks = {e.get("accession"): e for e in spectrum.iter() if name(e) == "cvParam"}
        value = lambda a: float(marks[a].get("value")) if a in marks else None  # noqa: B023, E731
        if value("MS:1000511") not in (1, 2):
            continue
        arrays = {"MS:1000514": np.empty(0), "MS:1000515": np.empty(0)}
        for box in (e for e in spectrum.iter() if name(e) == "binaryDataArray"):
            own = {e.get("accession") for e in box if name(e) == "cvParam"}
            raw = base64.b64decode("".join(e.text or "" for e in box if name(e) == "binary"))
            raw = zlib.decompress(raw) if "MS:1000574" in own and raw else raw
            for a in own & set(arrays):
                arrays[a] = np.frombuffer(raw, "<f4" if "MS:1000521" in own else "<f8").astype(float)
        mz, intensity = arrays.values()
        order = np.argsort(mz, kind="stable")
        number = re.search(r"scan=(\d+)", spectrum.get("id"))
        time = value("MS:1000016") / (1 if marks["MS:1000016"].get("unitAccession") == "UO:0000031" else 60)
        target, lower, upper = (value(f"MS:100082{i}") for i in (7, 8, 9))
        injection = value("MS:1000927")
        out.append((run, int(number[1]) if number else int(spectrum.get("index")) + 1, int(value("MS:1000511")), time, None if injection is None else injection / 1000, value("MS:1000285") if "MS:1000285" in marks else float(intensity.sum()), target, None if lower is None else target - lower, None if upper is None else target + upper, value("MS:1000045"), value("MS:1000501"), value("MS:1000500"), mz[order].tolist(), intensity[order].tolist()))
    return out
