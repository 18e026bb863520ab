import sys

from argosieve.cli import main

sys.exit(main())
