"""Command line entry."""

import sys

from siftbed.scan import main

sys.exit(main())
