import sys

from newsloom.cli import main

sys.exit(main())
