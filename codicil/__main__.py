import sys

from codicil.cli import main

sys.exit(main())
