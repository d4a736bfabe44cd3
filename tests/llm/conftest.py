import sys
from pathlib import Path

for folder in (Path(__file__).parent, Path(__file__).parents[1]):
    sys.path.insert(0, str(folder))
