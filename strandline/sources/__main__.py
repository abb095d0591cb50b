from strandline.sources.snapshots import main

raise SystemExit(main())
