import sys

from tidewell.cli import main

sys.exit(main())
