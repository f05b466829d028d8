"""The query keys one catalogue module registers: keys.py AREA."""

import re
import sys
from pathlib import Path

text = (Path(__file__).resolve().parents[1] / "stavework" / "catalog" / f"{sys.argv[1]}.py").read_text()
print(" ".join(re.findall(r'@query\("(\w+)"', text)))
