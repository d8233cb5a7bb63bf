import sys

from geoloom.cli import main

sys.exit(main())
