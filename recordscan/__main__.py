"""python -m recordscan"""

import sys

from .cli import main

sys.exit(main())
