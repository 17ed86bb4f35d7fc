from tessella.cli import main

raise SystemExit(main())
