import sys

from tickstat.plans.cli import main

sys.exit(main())
