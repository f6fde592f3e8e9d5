import sys

from geolattice.cli import main

sys.exit(main())
