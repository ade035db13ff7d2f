import sys

from tensorspark.cli import main

sys.exit(main())
