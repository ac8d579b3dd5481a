import sys

from dupscan.cli import main

sys.exit(main())
