"""python -m recordscan.package [FILE]: the library as one archive, to run (python FILE ...) or to ship (--py-files FILE)."""

from __future__ import annotations

import os
import sys
import zipfile

MAIN = "import sys\n\nfrom recordscan.cli import main\n\nsys.exit(main())\n"


def build(target: str = "recordscan.pyz") -> str:
    """Write all modules and texts of the package, and what starts the command line; returns the file's path."""
    top = os.path.dirname(os.path.abspath(__file__))
    with open(target, "wb") as f:
        f.write(b"#!/usr/bin/env python3\n")
    with zipfile.ZipFile(target, "a", zipfile.ZIP_DEFLATED) as z:
        z.writestr("__main__.py", MAIN)
        for folder, inner, files in os.walk(top):
            inner[:] = sorted(d for d in inner if d != "__pycache__")
            for name in sorted(files):
                if not name.endswith((".pyc", ".pyo")):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("recordscan", os.path.relpath(path, top)))
    os.chmod(target, 0o755)
    return target


if __name__ == "__main__":
    print(build(*sys.argv[1:2]))
