"""Archives and plain-Python models of what the Columns compute."""

from __future__ import annotations

import io
import sqlite3
import zipfile

from recordscan.functions.text import digits_of, normalize_text, token_list


def make_zip(path, members: dict[str, bytes | str] | list[tuple[str, bytes | str]], compression=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", compression) as z:
        for name, data in members.items() if isinstance(members, dict) else members:
            z.writestr(name, data)
    return path


def zip_bytes(members) -> bytes:
    b = io.BytesIO()
    make_zip(b, members)
    return b.getvalue()


def sqlite_bytes(folder, tables: dict[str, tuple[str, list[tuple]]]) -> bytes:
    path = folder / "made.sqlite"
    path.unlink(missing_ok=True)
    db = sqlite3.connect(path)
    for name, (columns, rows) in tables.items():
        db.execute(f'CREATE TABLE "{name}" ({columns})')
        for r in rows:
            db.execute(f'INSERT INTO "{name}" VALUES ({",".join("?" * len(r))})', r)
    db.commit()
    db.close()
    data = path.read_bytes()
    path.unlink()
    return data


def xlsx_bytes(rows: str, shared: str = "") -> bytes:
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    members = {"xl/worksheets/sheet1.xml": f'<worksheet xmlns="{ns}"><sheetData>{rows}</sheetData></worksheet>'}
    if shared:
        members["xl/sharedStrings.xml"] = f'<sst xmlns="{ns}">{shared}</sst>'
    return zip_bytes(members)


def model_score(text: str, patterns: list[str]) -> tuple[int, str, str] | None:
    """The ranking rules on one record, written from their specification."""
    normal, held, best = normalize_text(text), set(token_list(text)), None
    for p in patterns:
        tokens = token_list(p)
        full = sum(t in held for t in tokens)
        starts = sum(1 for t in tokens if len(t) >= 2 and t not in held and any(h.startswith(t) for h in held))
        if len(digits_of(p)) >= 7 and digits_of(p) in digits_of(text):
            found = (520, "phone")
        elif normalize_text(p) in normal:
            found = (500 + min(len(tokens), 9), "phrase")
        elif full == len(tokens):
            found = (400 + full, "all_tokens")
        elif full and full + starts == len(tokens):
            found = (300 + 10 * full + starts, "prefix_tokens")
        elif full:
            found = (100 + 10 * full, "partial_tokens")
        elif starts:
            found = (70 + starts, "prefix_partial")
        else:
            continue
        if best is None or found[0] > best[0]:
            best = (*found, p)
    return best
